"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from . import audiences, groups, mixing, neighbours, oracles, similar, spans, survivors, together, tokens


def p2_found(spark, d):
    return groups.repository_groups(table(spark, d, "github_cache"), table(spark, d, "repo_refs_cache"))


def p3_found(spark, d):
    return survivors.surviving_repositories(table(spark, d, "dependency_repo_aggregates"), table(spark, d, "github_cache")).select(
        "current_name", "title", "stargazers"
    )


def p3_records(spark, d):
    return survivors.surviving_repositories(table(spark, d, "dependency_repo_aggregates"), table(spark, d, "github_cache"))


def _sets(spark, d, name, key, items, time):
    """The latest version of each record with its cleaned set."""
    t = table(spark, d, name).where(F.col(key).isNotNull())
    set_ = F.coalesce(similar.clean_items(F.col(items)), F.array().cast("array<string>"))
    rows = t.select(F.col(key).alias("id"), set_.alias("items"), F.col(time).alias("at"))
    return rows.groupBy("id").agg(F.max_by("items", F.struct("at", "items")).alias("items"))


def p4_found(spark, d):
    tabs = [("topics", "record_id", "topics", "fetched_at"), ("shared_stargazers", "edge_id", "members", "found_at")]
    both = None
    for name, key, items, time in tabs:
        part = _sets(spark, d, name, key, items, time).select(F.lit(name).alias("tab"), "id", "items")
        both = part if both is None else both.unionByName(part)
    pairs = similar.similar_pairs(both, "id", "items", 0.7, scope="tab")
    return pairs.select("tab", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p5_nearest(spark, d):
    t = table(spark, d, "repo_text_embeddings").where(F.col("vec_id").isNotNull())
    last = t.groupBy("vec_id").agg(F.max_by("embedding", F.struct("embedded_at", "embedding")).alias("embedding"))
    return neighbours.nearest(last, "vec_id", "embedding", 5)


def p5_found(spark, d):
    near = p5_nearest(spark, d)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def _tag_pairs(spark, d, *bounds):
    return together.surprising_pairs(_sets(spark, d, "topics", "record_id", "topics", "fetched_at"), "id", "items", *bounds)


def p6_pairs(spark, d):
    """Every pair of tags that occurs, ranked among all."""
    return _tag_pairs(spark, d)


def p6_found(spark, d):
    """The pairs of a case; none of the columns that depend on the other pairs is given, so only pairs that can be a case are made."""
    return _tag_pairs(spark, d, 5, 3.0).select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"))


def _audiences(spark, d, least=500):
    slug = lambda c: F.lower(F.trim(F.col(c)))
    agg = table(spark, d, "repo_aggregates").groupBy(slug("repo").alias("repo")).agg(
        F.max_by(F.struct("stargazers"), F.struct("loaded_at", "stargazers"))["stargazers"].alias("stars")
    )
    big = agg.where(F.col("stars") >= least).select("repo")
    edges = table(spark, d, "shared_stargazers").groupBy("edge_id").agg(
        F.max_by(F.struct("a", "b", "members"), F.struct("found_at", "a", "b")).alias("e")
    ).select(slug("e.a").alias("a"), slug("e.b").alias("b"), similar.clean_items(F.col("e.members")).alias("m"))
    ends = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("repo"), "m").join(big, "repo", "left_semi")
    return ends.select("repo", F.explode("m").alias("member"))


def p7_overlaps(spark, d):
    return audiences.overlaps(_audiences(spark, d), "repo", "member")


def p7_found(spark, d):
    enough = F.col("common") >= F.lit(0.35) * F.least("size_a", "size_b")
    return p7_overlaps(spark, d).where(enough).select(F.col("a").alias("repo_a"), F.col("b").alias("repo_b"))


def p8_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents"))


def _mixed(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"), mixing.quality(F.col("text")).alias("weight")
    )
    return mixing.mix(docs, table(spark, d, "mix_targets"))


def p9_mix(spark, d):
    return _mixed(spark, d)


def p9_shares(spark, d):
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p10_share(spark, d):
    docs = table(spark, d, "documents")
    return spans.shared_fraction(docs, spans.shared_spans(docs))


QUERIES = {
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_overlaps": p7_overlaps,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p10_found": p10_found, "p10_share": p10_share, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLES = {**oracles.ORACLES}
