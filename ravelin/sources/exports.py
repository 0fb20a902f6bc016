"""What leaves the engine: edge lists, keyed tables, interned graphs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import running_sum


def edge_lines(edges: DataFrame) -> DataFrame:
    """Compact JSON arrays [a, b, weight(, members)], strongest first within equal order by name."""
    cols = ["a", "b", "w"] + (["members"] if "members" in edges.columns else [])
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for c in cols]), F.lit("]"))
    return edges.orderBy(F.col("w").desc(), "a", "b").select(text.alias("value"))


def write_tier(full: DataFrame, pruned: DataFrame, folder: str, as_json: bool = False) -> None:
    """Each tier twice: in full and pruned."""
    for name, e in (("full", full), ("pruned", pruned)):
        edge_lines(e).write.mode("overwrite").text(f"{folder}/{name}") if as_json else e.write.mode("overwrite").parquet(f"{folder}/{name}")


def keyed_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): each row's JSON, fields by name, rows by key."""
    rest = sorted(c for c in rows.columns if c != key)
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("value")).orderBy("key")


def interned(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids(node, id), edges(a_id, b_id, w)): dense numbers in name order."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("_one", F.lit(1))
    ids = running_sum(nodes, [], [F.col("node")], "_one", "_id").select("node", (F.col("_id") - 1).alias("id"))
    e = edges.join(ids.select(F.col("node").alias("a"), F.col("id").alias("a_id")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("b_id")), "b")
    return ids, e.select("a_id", "b_id", "w")


def inverted(pairs: DataFrame, item: str, key: str) -> DataFrame:
    """(item, holders): sorted distinct holders of each item."""
    return pairs.where(F.col(item).isNotNull()).groupBy(item).agg(F.array_sort(F.collect_set(key)).alias("holders"))


def summary(df: DataFrame, by: str, key: str, top: int = 15) -> DataFrame:
    """(by, n, percent): rows and their part of all for the most frequent values."""
    n = df.groupBy(by).agg(F.countDistinct(key).alias("n"))
    total = df.agg(F.countDistinct(key).alias("t"))
    return n.crossJoin(total).select(by, "n", F.round(100 * F.col("n") / F.col("t"), 1).alias("percent")).orderBy(F.col("n").desc(), by).limit(top)


def coverage(files: DataFrame, repo: str = "repo", ecosystem: str = "ecosystem", path: str = "path") -> DataFrame:
    """(ecosystem, repos, nested_only): repositories with a manifest of the ecosystem, and those that have none at their root."""
    per = files.where(F.col(ecosystem).isNotNull()).groupBy(repo, ecosystem).agg(F.max((~F.contains(F.col(path), F.lit("/"))).cast("int")).alias("root"))
    return per.groupBy(ecosystem).agg(F.count("*").alias("repos"), F.sum((F.col("root") == 0).cast("long")).alias("nested_only"))


def ranked_lines(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over n rows
