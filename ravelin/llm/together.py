"""Items that appear together: exact pair counts against a fitted bipartite configuration null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parts

#: Items of one slice of a basket; pairs are made between slices, so a row makes at most SLICE^2 of them.
SLICE = 32
#: Counts up to which a tail is a product of polynomials.
SHORT = 256


def fit_null(item_freq: np.ndarray, item_n: np.ndarray, basket_size: np.ndarray, basket_n: np.ndarray, rounds: int = 2000, tol: float = 1e-9, rows: int = 4096):
    """x per item frequency, y per basket size of the bipartite configuration model: an item is in a basket
    with p = x y / (1 + x y), and expected frequencies and sizes are the given ones. Items of equal frequency share x, baskets of equal
    size share y, so the system has as many unknowns as there are distinct frequencies and sizes; `rows` frequencies are held against all sizes at a time."""
    f, s = item_freq.astype(float), basket_size.astype(float)
    m, n = item_n.astype(float), basket_n.astype(float)
    total = max((f * m).sum(), 1.0)
    x, y = f / np.sqrt(total), s / np.sqrt(total)
    pieces = [slice(i, i + rows) for i in range(0, len(f), rows)]
    for _ in range(rounds):
        x2 = np.concatenate([f[p] / np.maximum((n * y / (1 + np.outer(x[p], y))).sum(1), 1e-300) for p in pieces]) if pieces else x
        y2 = s / np.maximum(sum((((m[p] * x2[p])[:, None] / (1 + np.outer(x2[p], y))).sum(0) for p in pieces), np.zeros(len(s))), 1e-300)
        change = max(np.max(np.abs(x2 - x) / np.maximum(x, 1e-300), initial=0), np.max(np.abs(y2 - y) / np.maximum(y, 1e-300), initial=0))
        x, y = np.minimum(x2, 1e12), np.minimum(y2, 1e12)
        if change < tol:
            break
    return x, y


def poisson_binomial_tail(k: int, q: np.ndarray, n: np.ndarray) -> float:
    """P(X >= k) for a sum of n[i] trials of chance q[i] each, exactly up to rounding, however far the tail and however many trials.

    Short distributions are the product of the binomial generating functions, from k up until they are negligible; the masses are
    non-negative and added from the small end, so far tails keep their digits. Long ones are found from the characteristic function (_tilted).
    """
    live = (q > 0) & (n > 0)
    q, n = np.minimum(q[live], 1 - 1e-15), n[live]
    if k <= 0:
        return 1.0
    if not len(q) or n.sum() < k:
        return 0.0
    mean, var = float((n * q).sum()), float((n * q * (1 - q)).sum())
    top = int(min(n.sum(), max(k, mean) + 40 + 12 * np.sqrt(var + 1)))
    if top > SHORT:
        return _tilted(k, q, n)
    dist = np.ones(1)
    for qi, ni in zip(q, n):
        m = int(min(ni, top))
        j = np.arange(1, m + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((ni - j + 1) / j) + np.log(qi) - np.log1p(-qi))]) + ni * np.log1p(-qi)
        pmf = np.exp(logs)
        use = np.flatnonzero(pmf > 1e-300)
        pmf = pmf[: use[-1] + 1] if len(use) else pmf[:1]
        dist = np.convolve(dist, pmf)[: top + 1]
    return float(min(1.0, dist[k:][::-1].sum())) if len(dist) > k else 0.0


def _tilted(k: int, q: np.ndarray, n: np.ndarray) -> float:
    """The tail by exponential tilting: with chances q e^t / (1 - q + q e^t) the mean is k, so the masses around k are the largest; they come from
    the characteristic function over a range of 28 standard deviations, and P(X = j) is theirs times e^(-t j) times the generating function."""
    if k == n.sum():
        return float(np.exp((n * np.log(q)).sum()))
    odds = (1 - q) / q
    tilt = 0.0
    if k > (n * q).sum():
        low, high = 0.0, 1.0
        while (n / (1 + odds * np.exp(-high))).sum() < k:
            low, high = high, 2 * high
        for _ in range(80):
            tilt = (low + high) / 2
            low, high = (tilt, high) if (n / (1 + odds * np.exp(-tilt))).sum() < k else (low, tilt)
    chance = 1 / (1 + odds * np.exp(-tilt))
    mean, width = float((n * chance).sum()), 28 * np.sqrt(float((n * chance * (1 - chance)).sum())) + 80
    size = 1 << int(np.ceil(np.log2(width)))
    turn = np.exp(2j * np.pi * np.arange(size // 2 + 1) / size)
    logs = np.zeros(len(turn), complex)
    for c, m in zip(chance, n):
        logs += m * np.log1p(c * (turn - 1))
    mass = np.maximum(np.fft.irfft(np.conj(np.exp(logs)), size), 0)
    j = int(mean) - size // 2 + np.arange(size)
    mass, j = mass[j % size], j
    if not tilt:
        return float(min(1.0, 1 - mass[(j < k) & (j >= 0)].sum())) if k > j[0] else 1.0
    over = j >= k
    inside = (mass[over] * np.exp(-tilt * (j[over] - k)))[::-1].sum()
    grown = (n * (tilt + np.log(q + (1 - q) * np.exp(-tilt)))).sum() - tilt * k
    return float(min(1.0, np.exp(np.log(inside) + grown))) if inside > 0 else 0.0


def pair_counts(baskets: DataFrame, basket: str, items: str, min_count: int = 1, max_item_part: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(pairs(a, b, n_ab, n_a, n_b), items(item, n), number of baskets) with exact counts.

    baskets has one row per basket with distinct items. Items below min_count, or in more than max_item_part of the baskets, are in no pair that can
    reach the caller's bounds and are left out of pairs before any is made, but counted. A long basket is cut into slices
    and each two slices are a row of their own, so no task makes all pairs of one basket; pairs are counted before the shuffle.
    """
    sets = baskets.select(F.col(basket).alias("k"), F.col(items).alias("i")).where(F.size("i") > 0)
    n = sets.count()
    freq = cut(sets.select(F.explode("i").alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    use = freq.where(F.col("n") >= min_count)
    if max_item_part is not None:
        use = use.where(F.col("n") <= n * max_item_part)
    flat = sets.select("k", F.explode("i").alias("item")).join(use.select("item", "n"), "item")
    short = flat.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("i")).where(F.size("i") > 1)
    last = ((F.size("i") - 1) / SLICE).cast("int")
    left = short.select("i", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_p"))
    both = left.select("i", "_p", F.explode(F.sequence("_p", "_last")).alias("_q"))
    both = both.select(F.slice("i", F.col("_p") * SLICE + 1, F.lit(SLICE)).alias("x"), F.slice("i", F.col("_q") * SLICE + 1, F.lit(SLICE)).alias("y"))
    pairs = both.select(F.explode("x").alias("a"), "y").select("a", F.explode(F.filter("y", lambda v: v["item"] > F.col("a.item"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    return (
        counted.select(F.col("a.item").alias("a"), F.col("b.item").alias("b"), "n_ab", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")),
        freq,
        n,
    )


def surprising_pairs(
    baskets: DataFrame, basket: str, items: str, min_count: int = 1, min_lift: float = 0.0, rate: float = 0.05
) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, lift, expected, p_value, q_value, significant): pairs of items, a < b, of at least min_count baskets and min_lift.

    lift is n_ab * n / (n_a * n_b). expected and p_value come from the fitted null in which items keep their frequency and baskets their size:
    n_ab is then a sum of independent trials with unequal chances (Poisson-binomial). Equal (n_a, n_b, n_ab) have one tail, computed once.
    q_value is Benjamini-Hochberg over all pairs of items, the untested ones counting with p = 1; significant: q_value <= rate.

    Cases: null and empty baskets are none; items must be distinct within a basket; baskets of one item count but make no pair; an empty table gives no rows.
    """
    part = 1.0 / min_lift if min_lift > 0 else None  # n_ab <= min(n_a, n_b), so lift <= n / max(n_a, n_b)
    pairs, freq, n = pair_counts(baskets, basket, items, min_count, part)
    # the null's sufficient statistics: how many items have each frequency, how many baskets each size
    f = freq.groupBy("n").agg(F.count("*").alias("m")).orderBy("n").toPandas()
    s = baskets.select(F.size(items).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("m")).orderBy("n").toPandas()
    x, y = fit_null(f["n"].to_numpy(), f["m"].to_numpy(), s["n"].to_numpy(), s["m"].to_numpy())
    of, many = dict(zip(f["n"].tolist(), x.tolist())), int(f["m"].sum())
    counts = s["m"].to_numpy()
    bounded = pairs.where((F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")) & (F.col("n_ab") >= min_count))
    found = cut(bounded.withColumn("lo", F.least("n_a", "n_b")).withColumn("hi", F.greatest("n_a", "n_b")))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            exp, p = [], []
            for lo, hi, k in zip(b["lo"], b["hi"], b["n_ab"]):
                u, v = of[lo] * y, of[hi] * y
                q = (u / (1 + u)) * (v / (1 + v))
                exp.append(float((counts * q).sum()))
                p.append(poisson_binomial_tail(int(k), q, counts))
            yield b[["lo", "hi", "n_ab"]].assign(expected=np.array(exp, float), p_value=np.array(p, float), m=b["m"])

    kinds = found.groupBy("lo", "hi", "n_ab").agg(F.count("*").alias("m"))
    tested = kinds.repartition(parts(kinds.sparkSession)).mapInPandas(tails, "lo long, hi long, n_ab long, expected double, p_value double, m long")
    ranked = bh(cut(tested), many * (many - 1) / 2)
    return found.join(ranked, ["lo", "hi", "n_ab"]).select(
        "a", "b", "n_ab", "n_a", "n_b", (F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))).alias("lift"), "expected", "p_value", "q_value", (F.col("q_value") <= rate).alias("significant")
    )


def bh(tested: DataFrame, tests: float) -> DataFrame:
    """q_value of rows (p_value, m) where m pairs share a p_value: min over larger p of p * tests / rank.

    Rows are range-partitioned by p; ranks and minima are carried over the pieces, one row each, so no task sees all rows.
    """
    placed = cut(tested.repartitionByRange(parts(tested.sparkSession), "p_value").withColumn("_piece", F.spark_partition_id()))
    w = Window.orderBy("_piece")  # over one row per piece
    sums = placed.groupBy("_piece").agg(F.sum("m").alias("m")).select("_piece", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_piece").orderBy("p_value").rangeBetween(Window.unboundedPreceding, 0)
    raw = placed.withColumn("_in", F.sum("m").over(here)).join(sums, "_piece")
    raw = cut(raw.withColumn("_q", F.col("p_value") * F.lit(float(tests)) / (F.col("_in") + F.col("_before"))))
    least = raw.groupBy("_piece").agg(F.min("_q").alias("q")).select("_piece", F.min("q").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    up = Window.partitionBy("_piece").orderBy("p_value").rangeBetween(0, Window.unboundedFollowing)
    out = raw.withColumn("_q", F.min("_q").over(up)).join(least, "_piece")
    return out.select(*tested.columns, F.least(F.lit(1.0), "_q", F.coalesce("_after", F.lit(1.0))).alias("q_value")).drop("m")
