"""Association strength, normalising and fusing of edge tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .overlap import dense_overlaps, overlap_edges


def positive_pmi(pairs: DataFrame, doc: str = "doc", item: str = "item", min_item: int = 1, min_pair: int = 1, dense: bool = False) -> DataFrame:
    """(a, b, w): ln(p_ab / (p_a p_b)) > 0 of items a < b in at least min_item documents each and min_pair together.

    Every document counts in the denominators, those of one item too. Items below the support are left out before pairs are made.
    dense: a good part of all pairs of items occurs, so they are counted without a shuffle of pairs.
    """
    if dense:
        edges, n = dense_overlaps(pairs, item, doc, min_pair, min_item)
        return edges.select("a", "b", F.log(F.col("w") * n / (F.col("ca") * F.col("cb"))).alias("w")).where(F.col("w") > 0)
    flat = pairs.select(F.col(doc).alias("d"), F.col(item).alias("i")).where(F.col("d").isNotNull() & F.col("i").isNotNull()).distinct()
    n = flat.select(F.countDistinct("d").alias("n"))
    freq = flat.groupBy("i").agg(F.count("*").alias("c")).where(F.col("c") >= min_item)
    edges = overlap_edges(flat.join(freq.select("i"), "i"), "i", "d", min_pair)
    w = F.log(F.col("w") * F.col("n") / (F.col("ca") * F.col("cb")))
    return (
        edges.join(freq.select(F.col("i").alias("a"), F.col("c").alias("ca")), "a").join(freq.select(F.col("i").alias("b"), F.col("c").alias("cb")), "b").crossJoin(n).select("a", "b", w.alias("w")).where(F.col("w") > 0)
    )


def min_max(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Weights scaled to [0, 1] over the tier; 1 where all are equal."""
    span = edges.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))  # one row
    w = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(weight) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return edges.crossJoin(span).withColumn(weight, w).drop("_lo", "_hi")


def fused(tiers: list[DataFrame]) -> DataFrame:
    """(a, b, w): the sum of the tiers' scaled weights of each unordered pair."""
    whole = None
    for t in tiers:
        one = min_max(cut(t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))))  # else made again for its span
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy("a", "b").agg(F.sum("w").alias("w"))
