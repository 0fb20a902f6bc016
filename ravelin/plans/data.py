"""Derived inputs that several queries share. Each is lazy and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.uris import short_predicate
from ..operators.eav import repo_slug
from ..runtime import latest, table


def stargazers(spark, d):
    """Distinct (left, item): repositories and the persons of their stargazer triples."""
    t = table(spark, d, "semrepo_nt").where((F.col("kind") == "uri") & F.col("p").endswith("hasStargazer"))
    return t.select(repo_slug(F.col("s")).alias("left"), F.substring_index("o", "/", -1).alias("item")).where("left is not null and item is not null").distinct()


STARGAZERS = """(SELECT DISTINCT lower(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/]+/)+?repository/([^/]+/[^/]+?)/?$', 1)) AS l, split_part(o, '/', -1) AS i
  FROM semrepo_nt WHERE kind = 'uri' AND p LIKE '%hasStargazer' AND o IS NOT NULL AND regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/]+/)+?repository/([^/]+/[^/]+?)/?$'))"""


def customer_parts(spark, d):
    """Distinct (left, item): customers and the parts they ordered."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("left"), F.col("l_partkey").alias("item")).distinct()


CUSTOMER_PARTS = "(SELECT DISTINCT o_custkey AS l, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def repo_topics(spark, d):
    """Distinct (repo, topic) of the latest version of each record."""
    t = latest(table(spark, d, "topics").where("record_id is not null"), ["record_id"], [F.col("fetched_at")], ["repo", "topics"])
    flat = t.select(F.lower("repo").alias("repo"), F.explode("topics").alias("topic"))
    return flat.select("repo", F.lower(F.trim("topic")).alias("topic")).where("repo is not null and topic <> ''").distinct()


REPO_TOPICS = """(SELECT DISTINCT * FROM (SELECT lower(repo) AS repo, lower(trim(unnest(topics))) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM topics)
  WHERE rn = 1 AND repo IS NOT NULL) WHERE topic <> '')"""


def star_edges(spark, d):
    """(a, b, w, members): the latest version of each shared-stargazer edge with its distinct members counted, a < b, one per pair."""
    e = latest(table(spark, d, "shared_stargazers").where("edge_id is not null"), ["edge_id"], [F.col("found_at")], ["a", "b", "members"])
    flat = e.select(F.lower("a").alias("x"), F.lower("b").alias("y"), F.explode("members").alias("m")).where("x is not null and y is not null and x <> y and trim(m) <> ''")
    return flat.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.array_sort(F.collect_set(F.lower(F.trim("m")))).alias("members")).select("a", "b", F.size("members").cast("long").alias("w"), "members")


STAR_EDGES = """(SELECT least(x, y) AS a, greatest(x, y) AS b, count(DISTINCT m) AS w FROM (SELECT lower(a) AS x, lower(b) AS y, lower(trim(unnest(members))) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY found_at DESC NULLS LAST) AS rn FROM shared_stargazers) WHERE rn = 1) WHERE x <> y AND m <> '' GROUP BY ALL)"""


def audience(spark, d):
    """(left, item): repositories and the persons of the shared-stargazer edges at them, once an edge."""
    e = latest(table(spark, d, "shared_stargazers").where("edge_id is not null"), ["edge_id"], [F.col("found_at")], ["a", "b", "members"])
    ends = e.select(F.explode(F.array(F.lower("a"), F.lower("b"))).alias("left"), F.col("members"))
    return ends.select("left", F.explode("members").alias("item")).select("left", F.lower(F.trim("item")).alias("item")).where("left is not null and item <> ''")


AUDIENCE = """(SELECT DISTINCT l, lower(trim(unnest(members))) AS i FROM (SELECT lower(a) AS l, members FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY found_at DESC NULLS LAST) AS rn FROM shared_stargazers) WHERE rn = 1
  UNION ALL SELECT lower(b), members FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY found_at DESC NULLS LAST) AS rn FROM shared_stargazers) WHERE rn = 1))"""


def pages(spark, d):
    """One row per lower slug: its latest ok page."""
    p = table(spark, d, "github_cache").where("status = 'ok' and repo is not null").withColumn("repo", F.lower("repo"))
    return latest(p, ["repo"], [F.col("fetched_at")], ["full_name", "fork", "parent_full_name", "archived", "stargazers_count", "language", "description", "created_at"])


PAGES = "(SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE (lower(repo) AS repo), row_number() OVER (PARTITION BY lower(repo) ORDER BY fetched_at DESC NULLS LAST) AS rn FROM github_cache WHERE status = 'ok' AND repo IS NOT NULL) WHERE rn = 1)"


def refs(spark, d):
    """Distinct (origin, object_id) of each repo's latest listing without error, the ids as bytes, which have the order of their digits."""
    r = table(spark, d, "repo_refs_cache").where("error is null and repo is not null and size(ids) > 0").withColumn("origin", F.lower("repo"))
    low = F.array_distinct(F.transform("ids", F.lower))
    r = r.withColumn("ids", F.transform(F.filter(low, lambda x: x.rlike("^[0-9a-f]{40}$")), F.unhex))
    return latest(r, ["origin"], [F.col("fetched_at")], ["ids"]).select("origin", F.explode("ids").alias("object_id"))


REFS = """(SELECT DISTINCT origin, lower(x) AS object_id FROM (SELECT origin, unnest(ids) AS x FROM (SELECT lower(repo) AS origin, ids, row_number() OVER (PARTITION BY lower(repo) ORDER BY fetched_at DESC NULLS LAST) AS rn
  FROM repo_refs_cache WHERE error IS NULL AND repo IS NOT NULL AND len(ids) > 0) WHERE rn = 1) WHERE regexp_full_match(lower(x), '[0-9a-f]{40}'))"""


def nation_edges(spark, d):
    """Directed (a, b): a nation's suppliers sold to another nation's customers; distinct pairs of nations of different supplier and customer segment keys."""
    s, c, o, li = (table(spark, d, t) for t in ("supplier", "customer", "orders", "lineitem"))
    flow = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    n = flow.groupBy(F.col("s_nationkey").alias("x"), F.col("c_nationkey").alias("y")).agg(F.sum(F.round(F.col("l_quantity"))).cast("long").alias("q"))
    back = n.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("q").alias("r"))
    return n.join(back, ["x", "y"]).where("q > r").select(F.format_string("nation%02d", "x").alias("a"), F.format_string("nation%02d", "y").alias("b"))


def predicates(spark, d):
    return table(spark, d, "semrepo_nt").select("line_no", "s", short_predicate(F.col("p")).alias("p"), "o", "kind")
