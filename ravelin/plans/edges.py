"""Joins, aggregations, windows and set operations over edges and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.uris import short_predicate
from ..operators import association, overlap, resolve
from ..runtime import table
from . import data

Q, SQL = {}, {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _overlap(pairs, k):
    return f"(SELECT x.l AS a, y.l AS b, count(*) AS w FROM {pairs} x JOIN {pairs} y ON x.i = y.i AND x.l < y.l GROUP BY ALL HAVING count(*) >= {k})"


def _either(edges, k):
    return f"""(SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY w DESC, o DESC) AS r FROM (SELECT a, b, w, a AS n, b AS o FROM {edges} UNION ALL SELECT a, b, w, b, a FROM {edges})) WHERE r <= {k} GROUP BY ALL)"""


def _mutual(edges, k):
    return _either(edges, k)[:-1] + " HAVING count(*) = 2)"


@query(f"SELECT a, b, w FROM {_either(_overlap(data.CUSTOMER_PARTS, 3), 4)}")
def j1_shared_parts_pruned(spark, d):
    """Customers that share parts, each kept with its four strongest."""
    return overlap.prune_either(overlap.overlap_edges(data.customer_parts(spark, d), min_shared=3), 4)


_AUDIENCE = f"(SELECT * FROM {data.AUDIENCE} WHERE i IS NOT NULL AND i <> '')"


@query(f"SELECT a, b, w FROM {_overlap(_AUDIENCE, 3)}")
def j1_shared_stargazers(spark, d):
    return overlap.dense_overlaps(data.audience(spark, d), min_shared=3)[0].select("a", "b", "w")


@query(f"SELECT x.repo AS a, y.repo AS b, count(*) AS w, list_sort(list(x.topic)) AS members FROM {data.REPO_TOPICS} x JOIN {data.REPO_TOPICS} y ON x.topic = y.topic AND x.repo < y.repo GROUP BY ALL HAVING count(*) >= 5")
def a4_shared_topics_members(spark, d):
    t = data.repo_topics(spark, d).select(F.col("repo").alias("left"), F.col("topic").alias("item"))
    return overlap.overlap_edges(t, min_shared=5, with_members=True)


@query(f"SELECT a, b, w FROM {_mutual(_overlap(data.CUSTOMER_PARTS, 3), 4)}")
def w3_mutual_neighbours(spark, d):
    return overlap.prune_mutual(overlap.overlap_edges(data.customer_parts(spark, d), min_shared=3), 4)


_FLOW = """(SELECT 'nation' || lpad(CAST(n.x AS varchar), 2, '0') AS a, 'nation' || lpad(CAST(n.y AS varchar), 2, '0') AS b FROM f n JOIN f m ON n.x = m.y AND n.y = m.x AND n.q > m.q)"""
_WITH_FLOW = """WITH f AS (SELECT s_nationkey AS x, c_nationkey AS y, CAST(sum(round(l_quantity)) AS bigint) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    e AS """ + _FLOW


@query(
    _WITH_FLOW
    + """, o AS (SELECT a, count(*) AS k FROM e GROUP BY 1), i AS (SELECT b, count(*) AS k FROM e GROUP BY 1),
    r AS (SELECT e.a, e.b, row_number() OVER (PARTITION BY e.a ORDER BY i.k DESC, e.b DESC) AS ra, row_number() OVER (PARTITION BY e.b ORDER BY o.k DESC, e.a DESC) AS rb FROM e JOIN o ON o.a = e.a JOIN i ON i.b = e.b) SELECT a, b FROM r WHERE ra <= 4 OR rb <= 4"""
)
def w2_degree_prune(spark, d):
    return overlap.prune_directed(data.nation_edges(spark, d), 4)


@query(_WITH_FLOW + " SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT a AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1")
def a6_degrees(spark, d):
    return overlap.degrees(data.nation_edges(spark, d))


@query(f"SELECT node, sum(w) AS degree FROM (SELECT a AS node, w FROM {data.STAR_EDGES} UNION ALL SELECT b, w FROM {data.STAR_EDGES}) GROUP BY 1")
def a12_weighted_degrees(spark, d):
    return overlap.weighted_degrees(data.star_edges(spark, d))


@query("SELECT regexp_extract(split_part(p, '/', -1), '([^#]*)$', 1) AS predicate, count(*) AS n FROM semrepo_nt WHERE p IS NOT NULL GROUP BY 1 ORDER BY n DESC, predicate")
def a1_predicate_counts(spark, d):
    t = table(spark, d, "semrepo_nt").where("p is not null")
    return t.groupBy(short_predicate(F.col("p")).alias("predicate")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "predicate")


@query(f"SELECT DISTINCT l AS repo FROM {data.STARGAZERS}")
def a2_repos_with_predicate(spark, d):
    return data.stargazers(spark, d).select(F.col("left").alias("repo")).distinct()


@query("SELECT s_nationkey AS a, c_nationkey AS b, count(DISTINCT l_partkey) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL")
def a5_folded_sources(spark, d):
    """The same edges from several sources, weighted by distinct coordinates."""
    s, c, o, li = (table(spark, d, t) for t in ("supplier", "customer", "orders", "lineitem"))
    flow = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    e = flow.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("l_partkey").alias("coord"), "l_returnflag")
    return overlap.folded([e.where("l_returnflag = 'A'").drop("l_returnflag"), e.where("l_returnflag <> 'A'").drop("l_returnflag"), e.where("l_returnflag = 'R'").drop("l_returnflag")]).drop("coords")


@query("SELECT s_nationkey AS repo, sum(n) AS mass FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def a7_reverse_mass(spark, d):
    """Occurrences, not distinct ones, summed over two steps."""
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier")
    return per.join(s, per.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("repo")).agg(F.sum("n").alias("mass"))


_PMI = f"""(WITH f AS (SELECT repo AS d, topic AS i FROM {data.REPO_TOPICS}), n AS (SELECT count(DISTINCT d) AS n FROM f), c AS (SELECT i, count(*) AS c FROM f GROUP BY 1 HAVING count(*) >= 3)
  SELECT x.i AS a, y.i AS b, ln(count(*) * any_value(n.n) / (any_value(ca.c) * any_value(cb.c))) AS w FROM f x JOIN f y ON x.d = y.d AND x.i < y.i JOIN c ca ON ca.i = x.i JOIN c cb ON cb.i = y.i, n GROUP BY x.i, y.i HAVING count(*) >= 3)"""


@query(f"SELECT a, b, round(w, 6) AS w FROM {_PMI} WHERE w > 0")
def a8_topic_pmi(spark, d):
    p = data.repo_topics(spark, d).select(F.col("repo").alias("doc"), F.col("topic").alias("item"))
    return association.positive_pmi(p, min_item=3, min_pair=3).select("a", "b", F.round("w", 6).alias("w"))


@query(
    f"""WITH s AS (SELECT l AS d, i FROM {_AUDIENCE}), n AS (SELECT count(DISTINCT i) AS n FROM s), c AS (SELECT d AS i, count(*) AS c FROM s GROUP BY 1 HAVING count(*) >= 5),
    e AS (SELECT x.d AS a, y.d AS b, ln(count(*) * any_value(n.n) / (any_value(ca.c) * any_value(cb.c))) AS w FROM s x JOIN s y ON x.i = y.i AND x.d < y.d JOIN c ca ON ca.i = x.d JOIN c cb ON cb.i = y.d, n GROUP BY x.d, y.d HAVING count(*) >= 3)
    SELECT a, b, round(w, 6) AS w FROM e WHERE w > 0"""
)
def a9_costar_pmi(spark, d):
    """The same operator with the roles turned: persons are the documents, repositories the items."""
    p = data.audience(spark, d).select(F.col("item").alias("doc"), F.col("left").alias("item"))
    return association.positive_pmi(p, min_item=5, min_pair=3, dense=True).select("a", "b", F.round("w", 6).alias("w"))


def _scaled(e):
    return f"(SELECT a, b, CASE WHEN max(w) OVER () = min(w) OVER () THEN 1.0 ELSE (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) END AS w FROM {e})"


@query(f"SELECT a, b, round(CAST(w AS double), 6) AS w FROM {_scaled('(SELECT a, b, CAST(w AS double) AS w FROM ' + data.STAR_EDGES + ')')}")
def a10_min_max(spark, d):
    return association.min_max(data.star_edges(spark, d).select("a", "b", F.col("w").cast("double").alias("w"))).select("a", "b", F.round("w", 6).alias("w"))


def _topic_overlap():
    return f"(SELECT x.repo AS a, y.repo AS b, CAST(count(*) AS double) AS w FROM {data.REPO_TOPICS} x JOIN {data.REPO_TOPICS} y ON x.topic = y.topic AND x.repo < y.repo GROUP BY ALL HAVING count(*) >= 4)"


@query(f"SELECT a, b, round(CAST(sum(w) AS double), 6) AS w FROM (SELECT * FROM {_scaled('(SELECT a, b, CAST(w AS double) AS w FROM ' + data.STAR_EDGES + ')')} UNION ALL SELECT * FROM {_scaled(_topic_overlap())}) GROUP BY a, b")
def a11_fused_tiers(spark, d):
    t = data.repo_topics(spark, d).select(F.col("repo").alias("left"), F.col("topic").alias("item"))
    return association.fused([data.star_edges(spark, d), overlap.overlap_edges(t, min_shared=4)]).select("a", "b", F.round("w", 6).alias("w"))


@query(
    f"""WITH al AS (SELECT repo AS k, lower(full_name) AS v FROM {data.PAGES} WHERE lower(full_name) <> repo), e AS (SELECT coalesce(x.v, a) AS a, coalesce(y.v, b) AS b, w FROM {data.STAR_EDGES} LEFT JOIN al x ON x.k = a LEFT JOIN al y ON y.k = b)
    SELECT a, b, max(w) AS w FROM e WHERE a <> b GROUP BY ALL"""
)
def a15_merged_edges(spark, d):
    al = data.pages(spark, d).where("lower(full_name) <> repo").select(F.col("repo").alias("alias"), F.lower("full_name").alias("canon"))
    return resolve.merged_edges(data.star_edges(spark, d), al).select("a", "b", "w")


@query(
    """SELECT doc_id, substr(sha256(text), 1, 16) AS hash, count(DISTINCT repo) OVER (PARTITION BY text) AS holders FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL
    QUALIFY count(DISTINCT repo) OVER (PARTITION BY text) > 1"""
)
def a16_copied_hashes(spark, d):
    f = table(spark, d, "documents").where("text is not null and repo is not null").select("doc_id", "repo", text.content_hash(F.col("text")).alias("hash"))
    return f.join(resolve.copied_hashes(f), "hash").select("doc_id", "hash", "holders")


@query(
    """WITH f AS (SELECT doc_id, repo, path, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL), c AS (SELECT h FROM f GROUP BY 1 HAVING count(DISTINCT repo) > 1)
    SELECT doc_id, path FROM f WHERE NOT contains(path, '/') OR h NOT IN (SELECT h FROM c)"""
)
def p8_own_files(spark, d):
    """Copies are dropped where nested; root files stay."""
    f = table(spark, d, "documents").where("text is not null and repo is not null and path is not null").select("doc_id", "repo", "path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return resolve.own_manifests(f).select("doc_id", "path")


Q["own_files"], SQL["own_files"] = Q.pop("p8_own_files"), SQL.pop("p8_own_files")


@query("SELECT source AS ecosystem, count(DISTINCT repo) AS repos, count(DISTINCT repo) - count(DISTINCT CASE WHEN NOT contains(path, '/') THEN repo END) AS nested_only FROM documents WHERE source IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL GROUP BY 1")
def a17_coverage(spark, d):
    from ..sources.exports import coverage

    f = table(spark, d, "documents").where("repo is not null and path is not null").select("repo", "path", F.col("source").alias("ecosystem"))
    return coverage(f)


@query("SELECT (SELECT stargazers FROM (SELECT stargazers, row_number() OVER (ORDER BY stargazers) - 1 AS r, count(*) OVER () AS n FROM repo_aggregates WHERE stargazers IS NOT NULL) WHERE r = n // 2) AS median")
def a22_upper_median(spark, d):
    return resolve.upper_median(table(spark, d, "repo_aggregates"), "stargazers")


@query(_WITH_FLOW + " SELECT (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)) AS nodes, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM e")
def a23_touched(spark, d):
    e = data.nation_edges(spark, d)
    ends = e.select(F.explode(F.array("a", "b")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    return ends.crossJoin(e.agg(F.countDistinct("a").alias("sources"), F.countDistinct("b").alias("targets")))


@query("SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host, count(*) AS n FROM repo_refs_cache WHERE url IS NOT NULL GROUP BY 1")
def a24_hosts(spark, d):
    t = table(spark, d, "repo_refs_cache").where("url is not null")
    return t.groupBy(F.substring_index(F.regexp_replace("url", "^https?://", ""), "/", 1).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def t1_top(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(200)


@query(f"SELECT b AS node, count(*) AS n FROM {data.STAR_EDGES} GROUP BY 1 ORDER BY n DESC, node LIMIT 15")
def t2_most_common(spark, d):
    return data.star_edges(spark, d).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "node").limit(15)


@query("SELECT DISTINCT lower(repo) AS repo FROM (SELECT repo FROM topics UNION ALL SELECT repo FROM repo_aggregates) WHERE repo IS NOT NULL")
def u1_union(spark, d):
    one = lambda t: table(spark, d, t).select(F.lower("repo").alias("repo"))
    return one("topics").union(one("repo_aggregates")).where("repo is not null").distinct()


@query("SELECT DISTINCT lower(repo) AS repo FROM topics WHERE repo IS NOT NULL AND lower(repo) IN (SELECT lower(repo) FROM repo_aggregates)")
def u3_intersection(spark, d):
    one = lambda t: table(spark, d, t).select(F.lower("repo").alias("repo")).where("repo is not null")
    return one("topics").intersect(one("repo_aggregates"))


@query("SELECT DISTINCT lower(repo) AS repo FROM topics WHERE repo IS NOT NULL AND lower(repo) NOT IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL)")
def u4_difference(spark, d):
    return resolve.without_own(table(spark, d, "topics").select(F.lower("repo").alias("repo")).where("repo is not null").distinct(), table(spark, d, "repo_aggregates").select(F.lower("repo").alias("repo")), ["repo"])


@query(
    f"""WITH RECURSIVE mv AS (SELECT repo AS k, lower(full_name) AS v FROM {data.PAGES} WHERE lower(full_name) <> repo), w(k, v, n) AS (SELECT k, v, 1 FROM mv UNION ALL SELECT w.k, mv.v, n + 1 FROM w JOIN mv ON mv.k = w.v WHERE n < 100)
    SELECT k AS alias, arg_max(v, n) AS canon FROM w GROUP BY 1"""
)
def u6_accumulated_aliases(spark, d):
    """New aliases over what an earlier run knew, chains followed to their ends."""
    al = data.pages(spark, d).where("lower(full_name) <> repo").select(F.col("repo").alias("alias"), F.lower("full_name").alias("canon"))
    even = F.pmod(F.xxhash64("alias"), F.lit(2)) == 0
    new, old = al.where(even), al.where(~even)
    return resolve.chains(new.unionByName(old.select("alias", "canon")))


@query(
    f"""WITH own AS (SELECT DISTINCT lower(repo) AS k FROM repo_aggregates WHERE repo IS NOT NULL), al AS (SELECT repo AS k, lower(full_name) AS v FROM {data.PAGES} WHERE lower(full_name) <> repo AND lower(full_name) IN (SELECT k FROM own)),
    ids AS (SELECT DISTINCT lower(repo) AS repo FROM topics WHERE repo IS NOT NULL) SELECT DISTINCT coalesce(al.v, ids.repo) AS node FROM ids LEFT JOIN al ON al.k = ids.repo"""
)
def u8_canonical_ids(spark, d):
    from .scans import _nodes

    ids = table(spark, d, "topics").where("repo is not null").select(F.lower("repo").alias("node")).distinct()
    return resolve.canonical_ids(ids, *_nodes(spark, d))


@query(
    f"""WITH own AS (SELECT DISTINCT lower(repo) AS k FROM repo_aggregates WHERE repo IS NOT NULL), al AS (SELECT repo AS k, lower(full_name) AS v FROM {data.PAGES} WHERE lower(full_name) <> repo AND lower(full_name) IN (SELECT k FROM own))
    SELECT rec_id, coalesce(al.v, own.k) AS node FROM (SELECT DISTINCT rec_id, lower(trim(repo)) AS q FROM dependency_repo_aggregates WHERE repo IS NOT NULL) LEFT JOIN al ON al.k = q LEFT JOIN own ON own.k = q"""
)
def j2_resolved_names(spark, d):
    from .scans import _nodes

    t = table(spark, d, "dependency_repo_aggregates").where("repo is not null").select("rec_id", F.lower(F.trim("repo")).alias("q")).distinct()
    return resolve.resolved(t, "q", resolve.lookup(*_nodes(spark, d)), "node").select("rec_id", "node")


@query("SELECT DISTINCT o_custkey AS a, s_nationkey + 1000000 AS b, l_suppkey AS coord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey".replace("o_custkey AS a, s_nationkey + 1000000 AS b", "'c' || o_custkey AS a, 'n' || s_nationkey AS b"))
def j3_coordinate_edges(spark, d):
    """Sources to coordinates to nodes."""
    o, li, s = (table(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    deps = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("C"), "o_custkey").alias("repo"), F.col("l_suppkey").alias("coord")).distinct()
    res = s.select(F.col("s_suppkey").alias("coord"), F.concat(F.lit("N"), "s_nationkey").alias("repo"))
    nodes = deps.select(F.lower("repo").alias("node")).union(res.select(F.lower("repo"))).distinct()
    none = spark.createDataFrame([], "alias string, canon string")
    return resolve.coordinate_edges(deps, res, resolve.lookup(nodes, none))


@query(
    """WITH f AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 4)
    SELECT o_custkey, l_suppkey, count(*) AS n FROM f JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def j4_capped_two_hops(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return resolve.two_hops(o, li, "o_custkey", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], 4).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT x.s_nationkey AS a, y.s_nationkey AS b FROM (SELECT l_orderkey AS k, coalesce(s_nationkey, l_suppkey) AS s_nationkey FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey) x JOIN (SELECT l_orderkey AS k, coalesce(s_nationkey, l_suppkey) AS s_nationkey FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey) y ON x.k = y.k AND x.s_nationkey <> y.s_nationkey")
def j6_both_ends(spark, d):
    """Both ends of a relation looked up, with the name itself where it is not known."""
    li, s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey"), table(spark, d, "supplier")
    e = li.join(s, li.l_suppkey == s.s_suppkey, "left").select("k", F.coalesce(F.col("s_nationkey").cast("long"), "l_suppkey").alias("n")).distinct()
    return e.select("k", F.col("n").alias("a")).join(e.select("k", F.col("n").alias("b")), "k").where("a <> b").select("a", "b").distinct()


_SMALL = f"(SELECT origin, object_id FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY object_id) AS r FROM {data.REFS}) WHERE r <= 96)"
_CAND = f"""(WITH s AS {_SMALL}, h AS (SELECT object_id FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40)
  SELECT DISTINCT x.origin AS a, y.origin AS b FROM s x JOIN s y ON x.object_id = y.object_id AND x.origin < y.origin WHERE x.object_id IN (SELECT object_id FROM h))"""


@query(f"SELECT a, b FROM {_CAND}")
def j7_sketch_candidates(spark, d):
    return overlap.sketch_candidates(data.refs(spark, d))


@query(
    f"""WITH r AS {data.REFS}, n AS (SELECT origin, count(*) AS n FROM r GROUP BY 1), c AS (SELECT k.a, k.b, count(*) AS shared FROM {_CAND} k JOIN r x ON x.origin = k.a JOIN r y ON y.origin = k.b AND y.object_id = x.object_id GROUP BY ALL)
    SELECT a, b, shared, round(shared / least(p.n, q.n), 6) AS containment, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM c JOIN n p ON p.origin = a JOIN n q ON q.origin = b WHERE shared >= 2 AND shared / least(p.n, q.n) >= 0.9"""
)
def j8_verified_containment(spark, d):
    r = data.refs(spark, d)
    got = overlap.same_by_containment(overlap.containment(overlap.sketch_candidates(r), r))
    return got.select("a", "b", "shared", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"))


@query(
    """SELECT raw_id, min(repo) AS repo FROM (SELECT raw_id, a.repo FROM (SELECT DISTINCT CASE WHEN record_id % 2 = 0 THEN lower(repo) ELSE split_part(lower(repo), '/', 2) || '/' || split_part(lower(repo), '/', 1) END AS raw_id FROM topics WHERE repo IS NOT NULL AND len(string_split(repo, '/')) = 2) r
    JOIN (SELECT DISTINCT lower(repo) AS repo FROM repo_aggregates WHERE repo IS NOT NULL) a ON a.repo = r.raw_id OR a.repo = split_part(raw_id, '/', 2) || '/' || split_part(raw_id, '/', 1)) GROUP BY 1"""
)
def j9_either_order(spark, d):
    low, two = F.lower("repo"), F.split(F.lower("repo"), "/")
    raw = F.when(F.col("record_id") % 2 == 0, low).otherwise(F.concat_ws("/", F.get(two, F.lit(1)), F.get(two, F.lit(0))))
    ids = table(spark, d, "topics").where("repo is not null and size(split(repo, '/')) = 2").select(raw.alias("raw_id")).distinct()
    known = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("repo")).distinct()
    return resolve.either_order(ids, known)


@query(
    """WITH a AS (SELECT lower(repo) AS repo, max(title) AS title, max(forks) AS forks FROM repo_aggregates WHERE repo IS NOT NULL GROUP BY 1), b AS (SELECT lower(trim(repo)) AS repo, max(title) AS title, max(forks) AS forks FROM dependency_repo_aggregates WHERE repo IS NOT NULL GROUP BY 1)
    SELECT coalesce(b.repo, a.repo) AS repo, coalesce(nullif(b.title, ''), nullif(a.title, '')) AS title, coalesce(b.forks, a.forks) AS forks FROM a FULL JOIN b ON a.repo = b.repo"""
)
def j10_merged_fields(spark, d):
    agg = lambda t, k: t.where("repo is not null").groupBy(k.alias("repo")).agg(F.max("title").alias("title"), F.max("forks").alias("forks"))
    return resolve.merged_fields(agg(table(spark, d, "repo_aggregates"), F.lower("repo")), agg(table(spark, d, "dependency_repo_aggregates"), F.lower(F.trim("repo"))), "repo", ["title", "forks"], ["title"])


@query(
    f"""WITH al AS (SELECT repo AS k, lower(full_name) AS v FROM {data.PAGES} WHERE lower(full_name) <> repo), r AS (SELECT lower(repo) AS repo, max(forks) AS forks, max(watchers) AS watchers FROM repo_aggregates WHERE repo IS NOT NULL GROUP BY 1),
    m AS (SELECT coalesce(al.v, repo) AS canon, al.v IS NOT NULL AS is_alias, r.* FROM r LEFT JOIN al ON al.k = repo)
    SELECT canon AS repo, first(forks ORDER BY is_alias, repo) FILTER (forks IS NOT NULL) AS forks, first(watchers ORDER BY is_alias, repo) FILTER (watchers IS NOT NULL) AS watchers FROM m GROUP BY 1"""
)
def j11_alias_collapse(spark, d):
    rows = table(spark, d, "repo_aggregates").where("repo is not null").groupBy(F.lower("repo").alias("repo")).agg(F.max("forks").alias("forks"), F.max("watchers").alias("watchers"))
    al = data.pages(spark, d).where("lower(full_name) <> repo").select(F.col("repo").alias("alias"), F.lower("full_name").alias("canon"))
    return resolve.collapsed_rows(rows, al, "repo", ["forks", "watchers"])


@query("SELECT rec_id, repo FROM dependency_repo_aggregates WHERE repo IS NOT NULL AND lower(repo) NOT IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL)")
def j12_unknown_ids(spark, d):
    t = table(spark, d, "dependency_repo_aggregates").where("repo is not null")
    return resolve.unknown(t, table(spark, d, "repo_aggregates").where("repo is not null"), "repo", "repo").select("rec_id", "repo")


@query(
    """SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS double[]), CAST(y.embedding AS double[])), 6) AS w FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
    WHERE list_cosine_similarity(CAST(x.embedding AS double[]), CAST(y.embedding AS double[])) >= 0.45"""
)
def j13_cosine_pairs(spark, d):
    e = overlap.cosine_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 0.45)
    return e.select("a", "b", F.round("w", 6).alias("w"))


@query(
    """WITH n AS (SELECT lang AS c, repo AS m FROM documents WHERE lang IS NOT NULL AND repo IS NOT NULL GROUP BY ALL), z AS (SELECT c, count(*) AS n FROM n GROUP BY 1)
    SELECT x.c AS a, y.c AS b, count(*) AS shared, round(count(*) / (zx.n + zy.n - count(*)), 6) AS jaccard FROM n x JOIN n y ON x.m = y.m AND x.c < y.c JOIN z zx ON zx.c = x.c JOIN z zy ON zy.c = y.c GROUP BY x.c, y.c, zx.n, zy.n"""
)
def j14_membership_jaccard(spark, d):
    m = table(spark, d, "documents").where("lang is not null and repo is not null").select(F.col("lang").alias("left"), F.col("repo").alias("item")).distinct()
    c = overlap.overlap_edges(m, min_shared=1)
    return overlap.containment(c.select("a", "b"), m, "left", "item").select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query(
    """WITH n AS (SELECT DISTINCT lower(repo) AS node FROM repo_aggregates WHERE repo IS NOT NULL), b AS (SELECT regexp_extract(node, '/(.*)$', 1) AS name, node FROM n), u AS (SELECT name, min(node) AS node FROM b GROUP BY 1 HAVING count(*) = 1 AND name <> '')
    SELECT 'lib' || name AS package, node FROM u WHERE NOT regexp_matches(name, '([0-9._]+|-dev|-bin|-utils|-tools)$') AND NOT regexp_matches(name, '^[-.]|[-.]$') AND 'lib' || name NOT IN (SELECT name FROM u)"""
)
def j15_name_matches(spark, d):
    """Packages named after repositories, found by variants of the name."""
    nodes = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("node")).distinct()
    bare = F.regexp_extract("node", "/(.*)$", 1)
    pk = nodes.select(bare.alias("_b")).where("_b <> '' and not _b rlike '([0-9._]+|-dev|-bin|-utils|-tools)$' and not _b rlike '^[-.]|[-.]$'").select(F.concat(F.lit("lib"), "_b").alias("package")).distinct()
    own = nodes.select(bare.alias("package")).distinct()
    return resolve.name_matches(pk.join(own, "package", "left_anti"), nodes)


@query("SELECT p_partkey, p_size % 3 <> 2 AS ok FROM part")
def j16_version_corroborated(spark, d):
    """Versions held against tags that write them in several ways."""
    p = table(spark, d, "part")
    k = F.col("p_size") % 3
    pairs = p.select("p_partkey", F.col("p_partkey").alias("origin"), F.format_string("2:%d.%d-1", "p_size", F.lit(7)).alias("v")).withColumn("version", F.regexp_extract("v", r"^\d+:(.*)-\d+$", 1))
    t = F.when(k == 0, F.format_string("name2-%d_7_1", "p_size")).when(k == 1, F.format_string("VER-%d-7", "p_size")).otherwise(F.format_string("v%d.8", "p_size"))
    return resolve.corroborated(pairs.select("p_partkey", "origin", "version"), p.select(F.col("p_partkey").alias("origin"), t.alias("tag"))).select("p_partkey", "ok")


_W4 = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 3 ELSE 1 END"


@query(_W4)
def w4_capped_sample(spark, d):
    n = F.when(F.col("event_type") == "click", 12).when(F.col("event_type") == "view", 3).otherwise(1)
    return resolve.first_n(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], n).select("event_id", "user_id", "event_type")


@query("SELECT repo, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY len(string_split(path, '/')), path, doc_id) AS rn FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL AND NOT contains(lower(path), 'docs/')) WHERE rn <= 3")
def w5_fetch_budget(spark, d):
    from ..functions.paths import fetch_key

    t = table(spark, d, "documents").where("repo is not null and path is not null and not contains(lower(path), 'docs/')")
    return resolve.first_n(t, ["repo"], [fetch_key(F.col("path")), F.col("doc_id")], 3).select("repo", "doc_id")


@query("SELECT lower(repo) AS repo, arg_min(title, rec_id) AS title FROM (SELECT DISTINCT rec_id, repo, coalesce(title, '') AS title FROM dependency_repo_aggregates WHERE repo IS NOT NULL) GROUP BY 1")
def w6_first_hit(spark, d):
    t = table(spark, d, "dependency_repo_aggregates").where("repo is not null").select("rec_id", F.lower("repo").alias("repo"), F.coalesce("title", F.lit("")).alias("title")).distinct()
    return resolve.first_n(t, ["repo"], [F.col("rec_id")], 1).select("repo", "title")


@query(
    f"""SELECT repo, language FROM (SELECT repo, language, stargazers_count AS s, row_number() OVER (PARTITION BY coalesce(CASE WHEN language = 'Jupyter Notebook' THEN 'Python' ELSE language END, '') ORDER BY stargazers_count DESC NULLS LAST, repo) AS rn FROM {data.PAGES}) WHERE rn <= 50 ORDER BY s DESC NULLS LAST, repo LIMIT 100"""
)
def w7_language_quota(spark, d):
    lang = F.when(F.col("language") == "Jupyter Notebook", "Python").otherwise(F.col("language"))
    return resolve.quota(data.pages(spark, d), lang, [F.col("stargazers_count").desc_nulls_last(), F.col("repo")], 100).select("repo", "language")


@query("SELECT doc_id FROM (SELECT doc_id, rank() OVER (PARTITION BY repo ORDER BY CASE source WHEN 'readme' THEN 0 WHEN 'wiki' THEN 1 ELSE 2 END) AS r FROM documents WHERE repo IS NOT NULL) WHERE r = 1")
def w8_priority_pick(spark, d):
    p = F.when(F.col("source") == "readme", 0).when(F.col("source") == "wiki", 1).otherwise(2)
    return resolve.by_priority(table(spark, d, "documents").where("repo is not null"), ["repo"], p).select("doc_id")


@query("SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') ORDER BY p_retailprice DESC, p_partkey LIMIT 300")
def t4_merged_streams(spark, d):
    """Two ranked streams as one ranked list."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return p.where("p_type = 'ECONOMY'").unionByName(p.where("p_type = 'STANDARD'")).orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(300)


@query("SELECT key, value, source FROM (SELECT key, value, source, row_number() OVER (PARTITION BY key ORDER BY source, value) AS rn FROM (SELECT lower(repo) AS key, title AS value, 0 AS source FROM repo_aggregates WHERE title IS NOT NULL UNION ALL SELECT lower(trim(repo)), title, 1 FROM dependency_repo_aggregates WHERE title IS NOT NULL) WHERE key IS NOT NULL) WHERE rn = 1")
def k5_first_filled(spark, d):
    a = table(spark, d, "repo_aggregates").where("title is not null").select(F.lower("repo").alias("key"), F.col("title").alias("value"))
    b = table(spark, d, "dependency_repo_aggregates").where("title is not null").select(F.lower(F.trim("repo")).alias("key"), F.col("title").alias("value"))
    return resolve.first_filled([a, b], "key", "value")


@query(f"SELECT repo, stargazers_count FROM {data.PAGES} ORDER BY stargazers_count DESC NULLS LAST, repo LIMIT 220")
def t3_candidate_pool(spark, d):
    """The pool of max(220, 2.2 n) best of which n are to be chosen, here for n = 100."""
    n = 100
    p = data.pages(spark, d).select("repo", "stargazers_count")
    return p.orderBy(F.col("stargazers_count").desc_nulls_last(), "repo").limit(max(220, int(2.2 * n)))


@query(
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY repo ORDER BY CASE lower(source) WHEN 'readme' THEN 0 WHEN 'changelog' THEN 1 WHEN 'wiki' THEN 2 END, doc_id) AS rn FROM documents WHERE repo IS NOT NULL AND lower(source) IN ('readme', 'changelog', 'wiki')) WHERE rn = 1"""
)
def w9_root_pick(spark, d):
    """One file per repository, by the priority of its kind."""
    k = F.lower("source")
    t = table(spark, d, "documents").where(F.col("repo").isNotNull() & k.isin("readme", "changelog", "wiki"))
    return resolve.first_n(t, ["repo"], [F.when(k == "readme", 0).when(k == "changelog", 1).otherwise(2), F.col("doc_id")], 1).select("doc_id")


@query(
    """WITH n AS (SELECT DISTINCT lower(repo) AS node FROM repo_aggregates WHERE repo IS NOT NULL), x AS (SELECT DISTINCT lower(repo) AS a, lower(trim(unnest(topics))) AS coord FROM topics WHERE repo IS NOT NULL), y AS (SELECT regexp_extract(node, '/(.*)$', 1) AS coord, min(node) AS b FROM n GROUP BY 1)
    SELECT a, b, count(DISTINCT x.coord) AS w FROM x JOIN y ON x.coord = y.coord WHERE a IN (SELECT node FROM n) AND a <> b GROUP BY ALL"""
)
def j5_used_packages(spark, d):
    """Used packages, here tags that are a repository's bare name, as edges with the number of distinct packages."""
    nodes = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("node")).distinct()
    res = nodes.groupBy(F.regexp_extract("node", "/(.*)$", 1).alias("coord")).agg(F.min("node").alias("repo"))
    deps = table(spark, d, "topics").where("repo is not null").select(F.lower("repo").alias("repo"), F.explode("topics").alias("t")).select("repo", F.lower(F.trim("t")).alias("coord")).where("coord is not null").distinct()
    none = spark.createDataFrame([], "alias string, canon string")
    e = resolve.coordinate_edges(deps, res, resolve.lookup(nodes, none))
    return overlap.folded([e]).select("a", "b", "w")


@query("SELECT repo, min(place) AS place FROM (SELECT lower(repo) AS repo, doc_id AS place FROM documents WHERE repo IS NOT NULL UNION ALL SELECT lower(repo), record_id + 1000000 FROM topics WHERE repo IS NOT NULL) GROUP BY 1")
def u2_source_union(spark, d):
    """Several sources as one list, the first occurrence holding."""
    a = table(spark, d, "documents").select(F.lower("repo").alias("repo"), F.col("doc_id").alias("place"))
    b = table(spark, d, "topics").select(F.lower("repo").alias("repo"), (F.col("record_id") + 1000000).alias("place"))
    return a.unionByName(b).where("repo is not null").groupBy("repo").agg(F.min("place").alias("place"))


QUERIES, ORACLES = Q, SQL
