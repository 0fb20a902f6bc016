"""Mixing sources to target weights by weighted sampling without replacement within whole epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, running_sum


def quality(text: Column) -> Column:
    """A positive weight from the text alone: the share of letters and blanks, damped for very short texts."""
    n = F.length(text)
    plain = n - F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), plain / n) * F.least(F.lit(1.0), F.greatest(F.lit(0.1), n / F.lit(200.0)))).otherwise(F.lit(0.05))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in (0, 1) fixed by seed and ids, so that a lost task draws the same again."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, uses): every document of a listed source, with how often the mixture uses it.

    docs: doc_id, source, tokens, weight. targets: source, target_share, max_repeats. Source names are compared
    without case and outer blanks. The total is the number of tokens in all documents of listed sources. A source's
    budget is its share of it, and at most max_repeats times its size; as many complete epochs as fit
    are taken, the rest by Efraimidis-Spirakis keys: documents by rising -ln(u)/weight, as long as their running
    sum of tokens stays within the rest of the budget; the document that crosses it is taken if that comes closer.

    Cases: a null or unlisted source is not used and not in the result; documents without tokens are used with the complete epochs
    only; a document appears once per row of docs; of a source listed twice the shares add up and the smaller
    max_repeats holds; null or negative shares and repeats count as 0; weights that are null, not
    positive or not finite count as the least positive weight; a listed source without documents has no rows.
    """
    name = lambda c: F.lower(F.trim(c))
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    want = targets.where(F.col("source").isNotNull()).groupBy(name(F.col("source")).alias("source")).agg(
        F.sum(zero(F.col("target_share"))).alias("share"), F.min(zero(F.col("max_repeats"))).cast("long").alias("most")
    )
    w = F.col("weight").cast("double")
    rows = cut(
        docs.select(
            F.col("doc_id"),
            name(F.col("source")).alias("source"),
            F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"),
            (-F.log(uniform(seed, F.col("doc_id"))) / F.when((w > 0) & (w < float("inf")), w).otherwise(F.lit(1e-9))).alias("_k"),
        ).join(want.select("source"), "source", "left_semi")
    )
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    plan = want.join(sizes, "source")
    budget = F.least(F.col("share") * F.lit(total), F.col("most") * F.col("size").cast("double"))
    plan = plan.select(
        "source",
        "most",
        F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
        F.when(F.col("size") > 0, budget - F.floor(budget / F.col("size")) * F.col("size")).otherwise(F.lit(0.0)).alias("rest"),
    )
    summed = running_sum(rows, ["source"], [F.col("_k"), F.col("doc_id")], "tokens", "_sum")
    extra = (F.col("tokens") > 0) & (F.col("_sum") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("most"))
    return summed.join(plan, "source").select("doc_id", "source", "tokens", (F.col("epochs") + extra.cast("long")).alias("uses"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, available_tokens, target_tokens, mixed_tokens, actual_share, docs_used, max_uses) of every
    listed source; actual_share is of the total of mix(), so that a source that can't fill its budget shows it."""
    per = mixed.groupBy("source").agg(
        F.sum("tokens").alias("available_tokens"),
        F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"),
        F.sum((F.col("uses") > 0).cast("long")).alias("docs_used"),
        F.max("uses").alias("max_uses"),
    )
    want = targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    per = cut(per)  # a row for each source
    total = per.agg(F.coalesce(F.sum("available_tokens"), F.lit(0))).first()[0]
    return want.join(per, "source", "left").select(
        "source",
        "target_share",
        z("available_tokens"),
        (F.col("target_share") * F.lit(total)).alias("target_tokens"),
        z("mixed_tokens"),
        (F.coalesce(F.col("mixed_tokens"), F.lit(0)) / F.lit(max(total, 1))).alias("actual_share"),
        z("docs_used"),
        z("max_uses"),
    )
