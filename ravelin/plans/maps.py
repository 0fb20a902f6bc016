"""Identity, graphs, hierarchies, layouts and questions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import explore, graph, identity, labels, layout, overlap, resolve
from ..runtime import cut, running_sum, stored, table
from . import data

Q, SQL = {}, {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_REACH = """WITH RECURSIVE e AS ({}), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT a, a FROM b UNION SELECT r.x, b.b FROM r JOIN b ON b.a = r.y)"""
_EVIDENCE = f"""SELECT repo AS a, lower(full_name) AS b FROM {data.PAGES} WHERE lower(full_name) <> repo UNION SELECT repo, lower(parent_full_name) FROM {data.PAGES} WHERE fork AND lower(parent_full_name) <> repo"""


def _ties(spark, d):
    p = data.pages(spark, d)
    return p, cut(identity.evidence(p, data.refs(spark, d)))


def _grouped(spark, d):
    p, ties = _ties(spark, d)
    return p, ties, cut(identity.groups(p, ties))


@query(_REACH.format(_EVIDENCE) + " SELECT x AS node, min(y) AS component FROM r GROUP BY 1")
def g1_components(spark, d):
    return graph.components(identity.declared(data.pages(spark, d)))


@query(
    _REACH.format(_EVIDENCE + f" UNION SELECT a, b FROM (WITH f AS {data.REFS}, n AS (SELECT origin, count(*) AS n FROM f GROUP BY 1) SELECT x.origin AS a, y.origin AS b FROM f x JOIN f y ON y.object_id = x.object_id AND x.origin < y.origin JOIN n p ON p.origin = x.origin JOIN n q ON q.origin = y.origin GROUP BY x.origin, y.origin, p.n, q.n HAVING count(*) >= 2 AND count(*) / least(p.n, q.n) >= 0.9)")
    + f""", p AS (SELECT *, coalesce(fork, false) AS fk FROM {data.PAGES}), comp AS (SELECT x, min(y) AS c FROM r GROUP BY 1), g AS (SELECT coalesce(c, repo) AS grp, p.* FROM p LEFT JOIN comp ON x = repo),
    nm AS (SELECT m.grp, min(m.repo) AS v FROM g m JOIN (SELECT DISTINCT grp, lower(full_name) AS f FROM g) f ON f.grp = m.grp AND f.f = m.repo WHERE NOT m.fk GROUP BY 1 HAVING count(DISTINCT m.repo) = 1),
    sc AS (SELECT m.grp, min(m.repo) AS v FROM g m JOIN (SELECT DISTINCT grp, lower(parent_full_name) AS f FROM g WHERE fk) f ON f.grp = m.grp AND f.f = m.repo GROUP BY 1 HAVING count(DISTINCT m.repo) = 1),
    rk AS (SELECT grp, first(repo ORDER BY fk, coalesce(archived, false), -coalesce(stargazers_count, 0), coalesce(created_at, '9999'), repo) AS v FROM g GROUP BY 1)
    SELECT rk.grp AS "group", coalesce(nm.v, sc.v, rk.v) AS canonical, CASE WHEN nm.v IS NOT NULL THEN 'full_name' WHEN sc.v IS NOT NULL THEN 'fork source' ELSE 'ranked' END AS canonical_by FROM rk LEFT JOIN nm USING (grp) LEFT JOIN sc USING (grp)"""
)
def g2_canonical(spark, d):
    p, _, grouped = _grouped(spark, d)
    return identity.canonical(grouped, p)


@query()
def g4_identity_records(spark, d):
    p, ties, grouped = _grouped(spark, d)
    return identity.records(grouped, cut(identity.canonical(grouped, p)), p, ties)


@query(
    f"""WITH r AS {data.REFS}, n AS (SELECT origin, count(*) AS n FROM r GROUP BY 1), k AS (SELECT repo AS a, lower(parent_full_name) AS b FROM {data.PAGES} WHERE fork AND lower(parent_full_name) <> repo),
    c AS (SELECT k.a, k.b, p.n AS na, q.n AS nb, (SELECT count(*) FROM r x JOIN r y ON x.object_id = y.object_id WHERE x.origin = k.a AND y.origin = k.b) AS shared FROM k LEFT JOIN n p ON p.origin = k.a LEFT JOIN n q ON q.origin = k.b)
    SELECT a, b, shared, CASE WHEN na IS NULL OR nb IS NULL THEN 'refs not known' WHEN shared < 2 THEN 'too few shared refs' WHEN shared / least(na, nb) < 0.9 THEN 'contains too little' END AS reason FROM c"""
)
def g3_verified_mirrors(spark, d):
    p = data.pages(spark, d).where("fork and lower(parent_full_name) <> repo").select(F.col("repo").alias("a"), F.lower("parent_full_name").alias("b"))
    return identity.verified_mirrors(p, data.refs(spark, d)).select("a", "b", "shared", "reason")


@query(f"SELECT repo, 'https://git.example/' || full_name AS url FROM {data.PAGES} WHERE full_name IS NOT NULL UNION SELECT lower(repo), url FROM repo_refs_cache WHERE repo IS NOT NULL AND url IS NOT NULL")
def u7_new_origins(spark, d):
    cur = data.pages(spark, d).where("full_name is not null").select("repo", F.concat(F.lit("https://git.example/"), "full_name").alias("url"))
    old = table(spark, d, "repo_refs_cache").where("repo is not null and url is not null").select(F.lower("repo").alias("repo"), "url").distinct()
    return identity.new_origins(old, cur)


@query()
def g5_heights(spark, d):
    return graph.heights(data.nation_edges(spark, d)).select("node", F.round("raw", 6).alias("raw"), F.round("height", 6).alias("height"))


@query()
def a21_incoherence(spark, d):
    e = cut(data.nation_edges(spark, d))
    return graph.incoherence(e, graph.heights(e))


@query()
def g6_height_of_new(spark, d):
    e = cut(data.nation_edges(spark, d))
    h = cut(graph.heights(e))
    deps = h.select(F.concat(F.lit("new-"), F.substring("node", -1, 1)).alias("node"), F.col("node").alias("dep"))
    return graph.height_of_new(deps, h, graph.scale(h).select("level_step_normalized"))


def _topic_pmi(spark, d):
    from .edges import a8_topic_pmi

    return a8_topic_pmi(spark, d)


@query()
def g7_topic_angles(spark, d):
    """Angles of the topics of the largest component of the association graph."""
    e = cut(_topic_pmi(spark, d))
    return layout.spectral(e)


@query()
def g8_costar_angles(spark, d):
    from .edges import a9_costar_pmi

    return layout.spectral(stored(a9_costar_pmi(spark, d)), normalised=False)


_ANGLE = "(SELECT event_type, 2 * pi() * (row_number() OVER (ORDER BY event_type) - 1) / 7 AS theta FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))"


@query(
    f"""WITH f AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM f), c AS (SELECT event_type, ln(any_value(n.n) / count(*)) AS w FROM f, n GROUP BY 1),
    s AS (SELECT user_id, sum(w * cos(theta)) AS x, sum(w * sin(theta)) AS y, sum(w) AS w FROM f JOIN c USING (event_type) JOIN {_ANGLE} USING (event_type) GROUP BY 1)
    SELECT f.user_id AS repo, CASE WHEN s.w > 0 THEN round(atan2(y, x), 6) END AS theta, CASE WHEN s.w > 0 THEN round(sqrt(x * x + y * y) / s.w, 6) ELSE 0.0 END AS r FROM (SELECT DISTINCT user_id FROM f) f LEFT JOIN s ON s.user_id = f.user_id"""
)
def a18_circular_means(spark, d):
    """Users as repositories, event types as topics with angles; one type has none. A type that every user has weighs nothing."""
    e = table(spark, d, "events")
    angle = spark.createDataFrame([(t, 2 * math.pi * i / 7) for i, t in enumerate(["click", "purchase", "signup", "view"])], "topic string, theta double")
    got = layout.repo_angles(e.select(F.col("user_id").alias("repo"), F.col("event_type").alias("topic")), angle)
    return got.select("repo", F.round("theta", 6).alias("theta"), F.round("r", 6).alias("r"))


def _unit(c):
    """A number in [0, 1) made of a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("long") / 16777216.0


def _u(k):
    return f"CAST('0x' || substr(md5({k}), 1, 6) AS bigint) / 16777216.0"


@query(
    f"""WITH t AS {data.REPO_TOPICS.strip()}, n AS (SELECT count(DISTINCT repo) AS n FROM t), c AS (SELECT topic, ln(any_value(n.n) / count(*)) AS w, {_u('topic')} * 6 AS a FROM t, n GROUP BY topic),
    s AS (SELECT repo, sum(w * cos(a)) AS x, sum(w * sin(a)) AS y, sum(w) AS w FROM t JOIN c USING (topic) GROUP BY 1)
    SELECT repo, CASE WHEN w <> 0 THEN round(atan2(y, x), 6) END AS theta, CASE WHEN w <> 0 THEN round(sqrt(x * x + y * y) / w, 6) ELSE 0.0 END AS r FROM s"""
)
def a18_topic_means(spark, d):
    """Every repository of the topics table, its tags with angles by name."""
    tags = data.repo_topics(spark, d)
    angle = tags.select("topic").distinct().select("topic", (_unit(F.col("topic")) * 6).alias("theta"))
    return layout.repo_angles(tags, angle).select("repo", F.round("theta", 6).alias("theta"), F.round("r", 6).alias("r"))


@query(
    """SELECT label, count(*) AS members, round(sqrt(power(sum(cos(t)), 2) + power(sum(sin(t)), 2)) / count(*), 6) AS length FROM (SELECT label, atan2(CAST(embedding[2] AS double), CAST(embedding[1] AS double)) AS t FROM embeddings) GROUP BY 1 HAVING count(*) >= 2"""
)
def a19_resultants(spark, d):
    e = table(spark, d, "embeddings").select("label", F.atan2(F.get("embedding", F.lit(1)).cast("double"), F.get("embedding", F.lit(0)).cast("double")).alias("theta"))
    return layout.resultant(e, "label", "theta").select("label", "members", F.round("length", 6).alias("length"))


@query()
def g15_compared_sources(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda i, j: F.atan2(F.get("embedding", F.lit(i)).cast("double"), F.get("embedding", F.lit(j)).cast("double"))
    a = e.select(F.col("vec_id").alias("repo"), at(1, 0).alias("theta"))
    b = e.select(F.col("vec_id").alias("repo"), F.when(F.col("vec_id") % 3 != 0, at(3, 2)).alias("theta"))
    return layout.compared_sources(a, b, e.select(F.col("vec_id").alias("repo"), F.col("label").alias("cluster")))


def _events_on_circle(spark, d):
    h = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 86400.0
    return table(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("event_type") != "error", h * 2 * math.pi).alias("theta"), (F.col("value") / 100).alias("height"))


_CIRCLE = "(SELECT event_id, user_id, value, CASE WHEN event_type <> 'error' THEN (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400.0 * 2 * pi() END AS theta, value / 100 AS height FROM events)"


@query(f"SELECT event_id FROM {_CIRCLE} WHERE height BETWEEN 0.1 AND 0.5 AND (theta >= 5.5 OR theta <= 1.0)")
def p15_band(spark, d):
    """A height interval and a wedge over zero; what has no angle is hidden."""
    return layout.band(_events_on_circle(spark, d), "height", "theta", (0.1, 0.5), (5.5, 1.0)).select("event_id")


Q["band_filter"], SQL["band_filter"] = Q.pop("p15_band"), SQL.pop("p15_band")


@query(f"SELECT user_id, round(min(height), 6) AS lo, round(max(height), 6) AS hi, CAST(coalesce(bit_or(1::bigint << CAST(least(floor(theta / (2 * pi()) * 32), 31) AS int)), 0) AS bigint) AS mask FROM {_CIRCLE} GROUP BY 1")
def cluster_band_masks(spark, d):
    b = layout.cluster_bands(_events_on_circle(spark, d), "user_id", "height", "theta")
    return b.select("user_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "mask")


@query(f"SELECT user_id, round(min(height), 6) AS lo, round(max(height), 6) AS hi FROM {_CIRCLE} GROUP BY 1 HAVING min(height) <= 0.2 AND max(height) >= 0.1 AND count(*) FILTER (least(floor(theta / (2 * pi()) * 32), 31) IN (0, 1, 30, 31)) > 0")
def clusters_in_band(spark, d):
    b = layout.cluster_in_band(layout.cluster_bands(_events_on_circle(spark, d), "user_id", "height", "theta"), (0.1, 0.2), (6.0, 0.3))
    return b.select("user_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_POINTS = f"""(SELECT repo AS node, t AS theta, r, h AS height, s AS stargazers, c AS cluster, r * 400 * cos(t) AS x, (h - 0.5) * 600 AS y, r * 400 * sin(t) AS z FROM
  (SELECT repo, {_u("repo || 't'")} * 2 * pi() AS t, {_u("repo || 'r'")} AS r, {_u("repo || 'h'")} AS h, stargazers_count AS s, coalesce(language, '?') AS c FROM {data.PAGES}))"""


def _repo_points(spark, d):
    """Invented coordinates of repositories: an angle and a radius by name, height by stars."""
    p = data.pages(spark, d)
    u = lambda k: _unit(F.concat("repo", F.lit(k)))
    t = p.select(F.col("repo").alias("node"), (u("t") * 2 * math.pi).alias("theta"), u("r").alias("r"), u("h").alias("height"), F.col("stargazers_count").alias("stargazers"), F.coalesce("language", F.lit("?")).alias("cluster"))
    return layout.positions(t)


@query(f"SELECT node, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM {_POINTS}")
def g20_positions(spark, d):
    return _repo_points(spark, d).select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 4).alias("z"))


@query(f"SELECT cluster, round(avg(height), 6) AS height, round(atan2(sum(sin(theta)), sum(cos(theta))), 6) AS theta, round(sqrt(power(sum(cos(theta)), 2) + power(sum(sin(theta)), 2)) / count(*), 6) AS r FROM {_POINTS} GROUP BY 1")
def g21_cluster_coordinates(spark, d):
    c = layout.cluster_coordinates(_repo_points(spark, d), "cluster")
    return c.select("cluster", *[F.round(x, 6).alias(x) for x in ("height", "theta", "r")])


@query(f"SELECT CAST(floor(x / 30) AS bigint) AS cx, CAST(floor(z / 30) AS bigint) AS cz, count(*) AS members, first(node ORDER BY coalesce(stargazers, 0) DESC, node) AS hub FROM {_POINTS} GROUP BY 1, 2 HAVING count(*) >= 4")
def g22_piles(spark, d):
    return layout.piles(_repo_points(spark, d))


@query()
def g23_hulls(spark, d):
    return layout.hull_members(_repo_points(spark, d), "cluster", radius=300.0)


@query()
def screen_projection(spark, d):
    p = layout.projected(_repo_points(spark, d), (0.0, 0.0, -900.0), 0.1, 0.05, 800.0, 1600.0, 900.0)
    return p.select("node", F.round("sx", 3).alias("sx"), F.round("sy", 3).alias("sy"), F.round("depth", 3).alias("depth"))


def _weighted(spark, d):
    return data.star_edges(spark, d).select("a", "b", F.col("w").cast("double").alias("w"))


@query()
def g9_communities(spark, d):
    return graph.communities(overlap.prune_mutual(_weighted(spark, d), 20), 2.0)


def _tree(spark, d):
    e = cut(_weighted(spark, d))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return e, graph.hierarchy(e, nodes)


@query()
def g10_hierarchy(spark, d):
    return _tree(spark, d)[1]


@query()
def g11_top_level(spark, d):
    return graph.without_singletons(_tree(spark, d)[1])[1]


@query()
def g12_members(spark, d):
    return graph.flat_members(_tree(spark, d)[1])


@query()
def a13_rollup(spark, d):
    e, tree = _tree(spark, d)
    flat = graph.flat_members(tree).select(F.col("member").alias("node"), F.col("cluster").alias("community"))
    p = data.pages(spark, d).select(F.col("repo").alias("node"), F.col("stargazers_count").alias("stargazers"))
    stats = p.join(overlap.weighted_degrees(e), "node", "full_outer").select("node", "stargazers", F.lit(None).cast("long").alias("forks"), "degree", F.lit(1).alias("members"))
    return graph.rollup(flat, stats)


@query(
    f"""WITH m AS (SELECT repo, coalesce(language, '?') AS c FROM {data.PAGES}) SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(w) AS w FROM {data.STAR_EDGES} e JOIN m x ON x.repo = e.a JOIN m y ON y.repo = e.b WHERE x.c <> y.c GROUP BY ALL"""
)
def a14_level_edges(spark, d):
    m = data.pages(spark, d).select(F.col("repo").alias("node"), F.coalesce("language", F.lit("?")).alias("community"))
    return graph.level_edges(data.star_edges(spark, d), m)


def _kinds(spark, d, t: str):
    """(level, cluster, member) of the repositories by two levels: language, and language with the first letter of the name."""
    p = data.pages(spark, d).select(F.col("repo").alias("member"), F.coalesce("language", F.lit("?")).alias("l"), F.crc32("repo").alias("k"))
    two = p.select("member", "k", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("l").alias("name")), F.struct(F.lit(1).alias("level"), F.concat("l", F.lit(" "), F.substring("member", 1, 1)).alias("name")))).alias("x"))
    rows = two.select("x.level", "x.name", "member", "k")
    if t == "new":  # members move and clusters merge, and numbers mean something else
        rows = rows.withColumn("name", F.when(F.pmod("k", F.lit(10)) == 0, "?").otherwise(F.col("name"))).withColumn("name", F.reverse("name"))
    names = rows.select("level", "name").distinct().withColumn("_one", F.lit(1))
    numbered = running_sum(names, ["level"], [F.col("name")], "_one", "i").select("level", "name", "i")
    return rows.join(numbered, ["level", "name"]).select("level", F.concat(F.lit("cluster/"), F.col("level").cast("string"), F.lit("/"), F.col("i").cast("string")).alias("cluster"), "member")


@query()
def g13_stable_ids(spark, d):
    """Clusters of two snapshots on two levels: in the later one a tenth of the members has moved and numbers are in another order."""
    return graph.stable_ids(_kinds(spark, d, "new"), _kinds(spark, d, "old"))


_LABELS = f"""WITH p AS (SELECT repo AS member, coalesce(language, '?') AS cluster FROM {data.PAGES}), n AS (SELECT cluster, string_agg(DISTINCT member, '|' ORDER BY member) AS s FROM p GROUP BY 1),
    b AS (SELECT cluster, string_agg(DISTINCT member, '|' ORDER BY member) AS s FROM p WHERE (cluster <> 'Rust' OR member < 'm') AND cluster <> 'Go' GROUP BY 1 UNION ALL SELECT 'gone', 'x'),
    j AS (SELECT coalesce(n.cluster, b.cluster) AS cluster, CASE WHEN n.s IS NULL THEN 'stale' WHEN b.s IS NULL THEN 'new' WHEN b.s = n.s THEN 'valid' ELSE 'changed' END AS state FROM n FULL JOIN b ON b.cluster = n.cluster)"""


@query(_LABELS + " SELECT cluster, CASE WHEN state = 'valid' THEN cluster END AS label, state FROM j")
def g14_label_cache(spark, d):
    p = data.pages(spark, d).select(F.col("repo").alias("member"), F.coalesce("language", F.lit("?")).alias("cluster"))
    now = labels.signatures(p, "cluster", "member")
    before = labels.signatures(p.where("cluster <> 'Rust' or member < 'm'"), "cluster", "member").where("cluster <> 'Go'").withColumn("label", F.col("cluster"))
    return labels.cache_state(before.unionByName(spark.createDataFrame([("gone", "x", "Gone")], "cluster string, signature string, label string")), now)


@query(_REACH.format(f"SELECT a, b FROM {data.STAR_EDGES}") + ", c AS (SELECT x, min(y) AS c FROM r GROUP BY 1) SELECT c AS component, count(*) AS size FROM c GROUP BY 1")
def g16_component_sizes(spark, d):
    return graph.component_sizes(data.star_edges(spark, d))


def _tiers(spark, d, among=None):
    """The edges of both tiers, or those between the nodes `among`."""
    t = data.repo_topics(spark, d).select(F.col("repo").alias("left"), F.col("topic").alias("item"))
    star = data.star_edges(spark, d)
    if among is not None:
        t, star = t.where(F.col("left").isin(among)), star.where(F.col("a").isin(among) & F.col("b").isin(among))
    star = star.select("a", "b", "w", F.lit("stargazer").alias("tier"), F.lit(0).alias("rank"))
    topic = overlap.overlap_edges(t, min_shared=4).select("a", "b", "w", F.lit("semantic").alias("tier"), F.lit(3).alias("rank"))
    return star.unionByName(topic)


@query()
def g17_shortest_path(spark, d):
    """From the first to the last repository of the largest component over both tiers. Pairs with common tags are made as they are asked for, and not kept."""
    schema = "hop int, node string, tier string"
    star = cut(data.star_edges(spark, d).select("a", "b"))
    both = cut(overlap.both_ways(star.withColumn("w", F.lit(0))).select(F.col("node").alias("u"), F.col("other").alias("v"), F.lit("stargazer").alias("tier"), F.lit(0).alias("rank")))
    lists = overlap.coded_lists(data.repo_topics(spark, d), 4, "repo", "topic")
    topic = overlap.dense_overlaps(lists.select(F.col("l").alias("left"), F.explode("h").alias("item")), min_shared=4, least=4)[0]
    comp = cut(graph.components(graph.stars(star).unionByName(graph.stars(topic))))
    big = comp.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).orderBy(F.col("n").desc(), "component").first()
    if big is None:
        return spark.createDataFrame([], schema)

    def near(nodes):
        tags = overlap.edges_of(nodes, lists, 4).select("u", "v", F.lit("semantic").alias("tier"), F.lit(3).alias("rank"))
        return both.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").select("u", "v", "tier", "rank").unionByName(tags)

    path = graph.path_between(near, lambda x: spark.createDataFrame([(x,)], "node string"), big["x"], big["y"])
    return spark.createDataFrame(path, schema)


@query(
    _WITH_NATION := f"""WITH RECURSIVE e AS (SELECT a, b FROM {data.STAR_EDGES}), m AS (SELECT min(a) AS s FROM e), z AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r(node, hop) AS (SELECT s, 0 FROM m UNION SELECT z.v, hop + 1 FROM r JOIN z ON z.u = r.node WHERE hop < 3)
    SELECT node, min(hop) AS hop FROM r GROUP BY 1"""
)
def g17_within_hops(spark, d):
    e = cut(data.star_edges(spark, d).select("a", "b"))
    return graph.within_hops(e, e.agg(F.min("a")).first()[0], 3)


@query(
    f"""WITH e AS (SELECT * FROM {data.STAR_EDGES}), p AS (SELECT a, b FROM e ORDER BY w DESC, a, b LIMIT 1), t AS (SELECT count(*) AS w FROM {data.REPO_TOPICS} x JOIN {data.REPO_TOPICS} y ON x.topic = y.topic, p WHERE x.repo = p.a AND y.repo = p.b)
    SELECT 'stargazer' AS tier, w FROM e JOIN p USING (a, b) UNION ALL SELECT 'semantic', CASE WHEN w >= 4 THEN w ELSE 0 END FROM t"""
)
def g18_compared(spark, d):
    """Only the pair's own tags meet, not those of all pairs."""
    top = data.star_edges(spark, d).select("a", "b", "w").orderBy(F.col("w").desc(), "a", "b").first()
    if top is None:
        return spark.createDataFrame([], "tier string, w long")
    return explore.compared(_tiers(spark, d, [top["a"], top["b"]]), top["a"], top["b"], ["stargazer", "semantic"])


@query()
def g19_tree_paths(spark, d):
    _, tree = _tree(spark, d)
    flat = tree.join(tree.select(F.col("cluster").alias("child")).distinct(), "child", "left_anti").select("child").distinct()
    n = flat.agg(F.min("child").alias("a"))
    return graph.tree_paths(flat.select(F.col("child").alias("b")).crossJoin(n).where("a <> b"), graph.ancestors(tree))


@query("SELECT DISTINCT lower(repo) AS repo, 'cohort' AS origin FROM repo_aggregates WHERE contains(lower(repo), 'ba') UNION ALL SELECT DISTINCT lower(repo), 'live' FROM github_cache WHERE contains(lower(repo), 'ba') AND lower(repo) NOT IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL)")
def g24_search(spark, d):
    one = lambda t: table(spark, d, t).where("repo is not null").select(F.lower("repo").alias("repo"))
    return explore.search(one("repo_aggregates"), one("github_cache"), "BA")


@query()
def g25_new_cards(spark, d):
    """Repositories with a page but no aggregates as newcomers: shared-tag edges of each."""
    tags = data.repo_topics(spark, d)
    known = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("repo")).distinct()
    old, new = tags.join(known, "repo", "left_semi"), tags.join(known, "repo", "left_anti")
    theta = tags.select("topic").distinct().select("topic", (_unit(F.col("topic")) * 6).alias("theta"))
    return explore.card(old, new, theta, 3)[1]


@query(
    f"""WITH t AS {data.REPO_TOPICS.strip()}, n AS (SELECT count(DISTINCT repo) AS n FROM t), c AS (SELECT topic, ln(any_value(n) / count(*)) AS w, {_u('topic')} * 6 AS a FROM t, n GROUP BY topic),
    s AS (SELECT repo, sum(w * cos(a)) AS x, sum(w * sin(a)) AS y, sum(w) AS w FROM t JOIN c USING (topic) WHERE repo NOT IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL) GROUP BY 1)
    SELECT repo, CASE WHEN w <> 0 THEN round(atan2(y, x), 6) END AS theta, CASE WHEN w <> 0 THEN round(sqrt(x * x + y * y) / w, 6) ELSE 0.0 END AS r FROM s"""
)
def g25_new_angles(spark, d):
    tags = data.repo_topics(spark, d)
    known = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("repo")).distinct()
    old, new = tags.join(known, "repo", "left_semi"), tags.join(known, "repo", "left_anti")
    theta = tags.select("topic").distinct().select("topic", (_unit(F.col("topic")) * 6).alias("theta"))
    return explore.card(old, new, theta, 3)[0].select("repo", F.round("theta", 6).alias("theta"), F.round("r", 6).alias("r"))


@query(_LABELS + " SELECT cluster FROM j WHERE state = 'stale'")
def u5_stale_keys(spark, d):
    return g14_label_cache(spark, d).where("state = 'stale'").select("cluster")


QUERIES, ORACLES = Q, SQL
