"""Distinctive terms and labels of classes of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heuristic_label, tokens


def class_terms(texts: DataFrame, group: str, text: str, top: int = 8) -> DataFrame:
    """(group, term, score, rank): class-based tf-idf. tf is the term's part of the class's words, idf is ln(1 + A / n) with the term's count n over all
    classes and the mean number of words A of classes that have any; ties by term, falling.

    Words are counted before they are shuffled, so a class of any size is a few counts per task.
    """
    words = texts.where(F.col(group).isNotNull()).select(F.col(group), F.explode(tokens(F.col(text))).alias("term"))
    counts = words.groupBy(group, "term").agg(F.count("*").alias("c"))
    size = counts.groupBy(group).agg(F.sum("c").alias("n"))
    mean = size.agg(F.avg("n").alias("a"))
    every = counts.groupBy("term").agg(F.sum("c").alias("t"))
    scored = counts.join(size, group).join(every, "term").crossJoin(mean).select(group, "term", (F.col("c") / F.col("n") * F.log1p(F.col("a") / F.col("t"))).alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("term").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def labels(terms: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, label) of every group; the fallback name where it has no terms."""
    t = terms.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return groups.select(group).distinct().join(t, group, "left").select(group, heuristic_label(F.col("terms")).alias("label"))


def signatures(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, signature): a digest of the set of members; equal sets have equal ones. It is made of their number and of sums of
    two hashes of each, so members of a group are never gathered; nulls are no members."""
    m = members.where(F.col(member).isNotNull()).select(group, member).distinct()
    total = F.sum(F.xxhash64(member).cast("decimal(20,0)"))
    return m.groupBy(group).agg(F.sha2(F.concat_ws("|", F.count("*"), total, F.bit_xor(F.xxhash64(F.lit(1), member))), 256).alias("signature"))


def cache_state(cache: DataFrame, current: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, label, state): valid where id and signature are as cached, changed where only the id is, new, or stale where no cluster has the id any more."""
    c = cache.select(group, "label", F.col("signature").alias("_old"))
    j = c.join(current.select(group, F.col("signature").alias("_new")), group, "full_outer")
    state = F.when(F.col("_new").isNull(), "stale").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("_new"), "valid").otherwise("changed")
    return j.select(group, F.when(state == "valid", F.col("label")).alias("label"), state.alias("state"))
