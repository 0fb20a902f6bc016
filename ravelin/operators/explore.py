"""Questions a reader asks of the finished graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .layout import repo_angles
from .overlap import overlap_edges, prune_either


def search(cohort: DataFrame, live: DataFrame, text: str, key: str = "repo") -> DataFrame:
    """(key, origin): ids that hold the text, without case; of an id in both only the cohort's."""
    hit = lambda df, o: df.where(F.contains(F.lower(key), F.lit(text.lower()))).select(key, F.lit(o).alias("origin")).distinct()
    a = hit(cohort, "cohort")
    return a.unionByName(hit(live, "live").join(a.select(key), key, "left_anti")).orderBy("origin", key)


def compared(tiers: DataFrame, x: str, y: str, names: list[str] | None = None) -> DataFrame:
    """(tier, w) of every tier's unpruned edge between two nodes, 0 where there is none; tiers are those of the edges, or `names`, which tiers without an edge have too."""
    every = tiers.select("tier").distinct() if names is None else tiers.sparkSession.createDataFrame([(n,) for n in names], "tier string")
    mine = tiers.where(((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x))).groupBy("tier").agg(F.max("w").alias("w"))
    return every.join(mine, "tier", "left").select("tier", F.coalesce("w", F.lit(0)).alias("w"))


def side_by_side(rows: DataFrame, x: str, y: str, key: str, fields: list[str]) -> DataFrame:
    """(field, x, y) of two nodes' rows."""
    long = rows.where(F.col(key).isin(x, y)).select(key, F.explode(F.create_map(*[c for f in fields for c in (F.lit(f), F.col(f).cast("string"))])).alias("field", "v"))
    return long.groupBy("field").agg(F.max(F.when(F.col(key) == x, F.col("v"))).alias("x"), F.max(F.when(F.col(key) == y, F.col("v"))).alias("y"))


def card(tags: DataFrame, new_tags: DataFrame, topic_theta: DataFrame, min_shared: int = 2, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(angle, edges) of repositories outside the graph: the angle from known topic angles, edges by shared tags, thinned as the graph's are.

    tags, new_tags: (repo, topic). Topic counts are those of the known graph and the new rows together.
    """
    every = tags.unionByName(new_tags).distinct()
    angle = repo_angles(every, topic_theta).join(new_tags.select("repo").distinct(), "repo", "left_semi")
    new = new_tags.select("repo").distinct()
    use = every.join(new_tags.select("topic").distinct(), "topic", "left_semi")
    left = F.struct("repo", F.coalesce("_new", F.lit(False)).alias("new")).alias("left")  # pairs of known ones fall before they are compared
    marked = use.join(new.withColumn("_new", F.lit(True)), "repo", "left").select(left, F.col("topic").alias("item"))
    edges = overlap_edges(marked, min_shared=min_shared).where("a.new or b.new")
    touch = cut(edges.select(F.col("a.repo").alias("a"), F.col("b.repo").alias("b"), "w"))
    return angle, prune_either(touch, k)
