"""The k most similar vectors of every vector, by additive quantisation with exact reranking.

1. Codebooks: `LEVELS` full-dimensional books of residual k-means over at most `train_rows` vectors (a documented bound: the
   books are fitted on a sample, every vector is encoded and searched).
2. Encoding: beam search over the sums of one word per book, by the exact error of the whole sum; the norm of the sum is stored.
3. Cells are those of k-means centres over the same sample, one for some `CELL` vectors; runs of neighbouring cells make blocks of some `BLOCK` vectors,
   and a larger cell is spread over several blocks. A vector visits the blocks of its nearest cells, `PROBES` at least and as many as hold `reach` vectors.
4. In a block, vectors are scored by lookup tables of the query's products with all words, the best `rerank` of them exactly; those that tie with the last one are kept whole,
   and a list that ends among equal ones is made from the whole block.
5. Vectors whose lists hang together by entries of at least `NEAR` meet as a whole, exactly: so two halves of a cluster that cells have parted are joined by any one
   of them that has found the other half. Groups are what `HOPS` steps reach; one of more than BLOCK vectors is dealt to several.

Work per vector is reach and block bound, so the whole grows with the number of vectors, not its square, up to CELL * CELLS vectors; beyond, cells grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, parts

LEVELS, WORDS, BEAM, BLOCK, CHUNK = 6, 256, 4, 2048, 4096
CELL, CELLS, PROBES, NEAR, HOPS = 512, 2048, 4, 0.5, 3
#: Vectors whose unit vectors agree in AXES fixed projections, in steps of GRID, are one direction: far below the 6 decimals, above float32's rounding.
AXES, GRID = 8, 1e-7


def usable(v: str, dim: int):
    """A vector of dim finite numbers that are not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(x: np.ndarray) -> np.ndarray:
    """(n, AXES) whole numbers, alike for vectors that differ in their norm. Copies at a step's border may get several, which costs but loses nothing."""
    axes = np.random.default_rng(11).normal(size=(x.shape[1], AXES))
    return np.rint(unit(x) @ (axes / np.linalg.norm(axes, axis=0)) / GRID).astype(np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], np.cumsum(n)[:-1]]), len(x) - 1), axis=0)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def chained(c: np.ndarray) -> np.ndarray:
    """The rows in an order in which neighbours are near."""
    left, chain = np.arange(1, len(c)), [0]
    while len(left):
        at = int(np.argmin(((c[left] - c[chain[-1]]) ** 2).sum(1)))
        chain.append(int(left[at]))
        left = np.delete(left, at)
    return c[chain]


def centres(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Unit vectors, one for each CELL of n vectors, CELLS at most, in an order in which neighbours are near."""
    c = k_means(x.astype(np.float32), max(1, min(n // CELL, CELLS, len(x) // 2)), np.random.default_rng(seed))
    return chained(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))


def train(x: np.ndarray, levels: int, words: int, seed: int) -> np.ndarray:
    """(levels, words, dim) residual codebooks."""
    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
    k = max(1, min(words, len(x) // 2))
    for _ in range(levels):
        c = k_means(rest, k, rng)
        books.append(c)
        rest = rest - c[np.argmax(rest @ c.T - 0.5 * (c * c).sum(1), axis=1)]
    return np.stack(books)


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.m, self.k, self.dim = books.shape
        self.flat = self.books.reshape(self.m * self.k, self.dim)
        gram = (self.flat @ self.flat.T).reshape(self.m, self.k, self.m, self.k)
        self.gram, self.sq = gram, (self.books * self.books).sum(2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes (n, levels) uint8 and the norms of their sums."""
        n = len(x)
        ip = (x.astype(np.float32) @ self.flat.T).reshape(n, self.m, self.k)
        cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
        for level in range(self.m):
            c = cost[:, :, None] + (self.sq[level] - 2 * ip[:, level])[:, None, :]
            for j in range(level):
                c = c + 2 * self.gram[j][codes[:, :, j], level]
            width, keep = c.shape[1], min(BEAM, c.shape[1] * self.k)
            c = c.reshape(n, -1)
            best = np.argpartition(c, keep - 1, axis=1)[:, :keep] if keep < c.shape[1] else np.tile(np.arange(c.shape[1]), (n, 1))
            cost = np.take_along_axis(c, best, 1)
            parent = best // self.k if width > 1 else np.zeros_like(best)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), (best % self.k)[:, :, None]], axis=2)
        pick = np.argmin(cost, axis=1)
        rows = np.arange(n)
        code = codes[rows, pick]
        dot = ip[rows[:, None], np.arange(self.m)[None, :], code].sum(1)
        return code.astype(np.uint8), np.sqrt(np.maximum(cost[rows, pick] + 2 * dot, 1e-12))

    def table(self, q: np.ndarray) -> np.ndarray:
        return q.astype(np.float32) @ self.flat.T


def layout(counts: dict[int, int], k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cells, their sizes, the first block and the number of blocks of each; cells in order, blocks of about BLOCK vectors."""
    cells = np.array(sorted(counts), np.int64)
    size = np.array([counts[c] for c in cells.tolist()], np.int64)
    first, many, block, fill = [], [], 0, 0
    for n in size.tolist():
        if n > BLOCK:
            block += fill > 0
            s = -(-n // BLOCK)
            first.append(block)
            many.append(s)
            block, fill = block + s, 0
            continue
        if fill + n > BLOCK:
            block, fill = block + 1, 0
        first.append(block)
        many.append(1)
        fill += n
    return cells, size, np.array(first, np.int64), np.array(many, np.int64)


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 5, dim: int = 384, train_rows: int = 8192, reach: int = 800, rerank: int = 192, digits: int = 6, seed: int = 3) -> DataFrame:
    """(id, other, cos, rank): the k most similar others of every usable vector, by cosine rounded to `digits`, ties by smaller id.

    vectors has one row per key. Vectors of one direction are one point of the index, so copies of any norm, of which there may be any number, cost one search;
    a copy's list is made of the smallest ids of its own and of the found points.

    Cases: null keys and unusable vectors (another length, a null, NaN or infinite part, all zero) are left out; a vector is no neighbour of itself; with fewer than
    k others all are listed; repeated rows change nothing; an empty table gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    more = k + 1
    ok = vectors.where(F.col(key).isNotNull() & usable(vector, dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    ok = ok.where(usable("v", dim))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            h = pa.array([r.tobytes() for r in direction(v)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), h], names=["id", "v", "h"])

    ok = cut(ok.mapInArrow(keyed, "id long, v array<float>, h binary"))  # read twice, and must then be the same
    heads = ok.groupBy("h").agg(F.min_by(F.struct("id", "v"), "id").alias("p"))
    member = cut(ok.select("h", "id").distinct())
    points = cut(heads.select("h", F.col("p.id").alias("id"), F.col("p.v").alias("v")).repartition(parts(spark)))
    sample = points.select("v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(train_rows).toArrow().column("v").combine_chunks()
    schema = "id long, other long, cos double, rank int"
    if not len(sample):
        return spark.createDataFrame([], schema)
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(train(unit(x), LEVELS, WORDS, seed))
    middles = spark.sparkContext.broadcast(centres(unit(x), points.count(), seed))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(shared.value)
        for b in batches:
            for at in range(0, len(b), 1024):
                s = b.slice(at, 1024)
                v = s.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
                codes, norms = q.encode(unit(v))
                cell = np.argmax(unit(v).astype(np.float32) @ middles.value.T, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [s.column("id"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(cell.astype(np.int32))],
                    names=["id", "v", "code", "norm", "cell"],
                )

    coded = cut(points.select("id", "v").mapInArrow(encode, "id long, v binary, code binary, norm float, cell int"))
    counts = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    plan = spark.sparkContext.broadcast(layout(counts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, size, first, many = plan.value
        middle = middles.value[cells].T
        for b in batches:
            ids = b.column("id").to_numpy()
            mine = np.searchsorted(cells, b.column("cell").to_numpy())
            home = first[mine] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[mine]
            visits: list[list[int]] = []
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            for at in range(0, len(v), 256):
                s = unit(v[at : at + 256]).astype(np.float32) @ middle
                top = min(512, len(cells))
                near = np.argpartition(-s, top - 1, axis=1)[:, :top]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
                before = np.cumsum(size[near], axis=1) - size[near]
                for r in range(len(near)):
                    c = near[r][(before[r] < reach) | (np.arange(top) < PROBES)]
                    seen = {f + e for f, m in zip(first[c].tolist(), many[c].tolist()) for e in range(m)}
                    visits.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "v", "code", "norm")), pa.array(home.astype(np.int32)), pa.array(visits, pa.list_(pa.int32()))], names=["id", "v", "code", "norm", "home", "visits"]
            )

    placed = cut(coded.mapInArrow(place, "id long, v binary, code binary, norm float, home int, visits array<int>"))
    load = placed.select(F.explode("visits").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = placed.select(F.col("home").alias("block"), "id", "v", "code", "norm").join(load, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v", "code", "norm"
    )
    asks = placed.select(F.col("id").alias("ask"), F.col("v").alias("asked"), F.explode("visits").alias("block")).join(load, "block")
    asks = asks.select(F.col("block").alias("to"), F.pmod(F.xxhash64("ask"), "chunks").cast("int").alias("part"), "ask", "asked")

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"id": [], "other": [], "cos": []}).astype({"id": "int64", "other": "int64"})
        q = Quantiser(shared.value)
        ids = own["id"].to_numpy()
        x = unit(np.frombuffer(b"".join(own["v"]), np.float32).reshape(-1, dim))
        codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), q.m).astype(np.int64)
        # equal codes have equal scores, to the bit
        codes, which = np.unique(codes, axis=0, return_inverse=True)
        which = which.reshape(-1)
        back = np.zeros(len(codes), np.float32)
        back[which] = 1 / own["norm"].to_numpy()
        asked, qs = ask["ask"].to_numpy(), np.frombuffer(b"".join(ask["asked"]), np.float32).reshape(-1, dim)
        # queries of one region come together: a slice's candidates are few, and one product reranks them all
        qs = unit(qs)
        order = np.argsort(np.argmax(qs.astype(np.float32) @ q.books[0].T, axis=1), kind="stable")
        qs, asked = qs[order], asked[order]
        out = []
        for at in range(0, len(asked), 64):
            y, who = qs[at : at + 64], asked[at : at + 64]
            t = q.table(y)
            score = t[:, codes[:, 0]]
            for m in range(1, q.m):
                score += t[:, m * q.k + codes[:, m]]
            score *= back
            score = score[:, which]
            keep = min(rerank, len(ids))
            best = np.argpartition(-score, keep - 1, axis=1)
            last = np.take_along_axis(score, best[:, keep - 1 : keep], 1)
            tied = int((score >= last).sum(1).max())
            best = best[:, :keep] if tied == keep else np.argpartition(-score, tied - 1, axis=1)[:, :tied]
            some = np.unique(best)
            exact = y @ x[some].T
            cos = np.round(np.take_along_axis(exact, np.searchsorted(some, best), 1), digits)
            other = ids[best]
            cos[other == who[:, None]] = -9
            order = np.lexsort((other, -cos), axis=1)[:, : more + 1]
            cos, other = np.take_along_axis(cos, order, 1), np.take_along_axis(other, order, 1)
            if cos.shape[1] > more and tied < len(ids):
                # the list ends among equal ones, of which the score may have left out some: these meet the whole block
                for r in np.flatnonzero((cos[:, more - 1] == cos[:, more]) & (cos[:, more] > -9)):
                    every = np.round(x @ y[r], digits)
                    every[ids == who[r]] = -9
                    first = np.lexsort((ids, -every))[: more + 1]
                    cos[r], other[r] = every[first], ids[first]
            cos, other = cos[:, :more], other[:, :more]
            real = cos > -9
            out.append((np.repeat(who, real.sum(1)), other[real], cos[real]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"id": a, "other": b, "cos": c})

    hits = members.groupBy("block", "chunk").cogroup(asks.groupBy("to", "part")).applyInPandas(search, "id long, other long, cos double")
    # bounded: k + 1 of each visited block
    best = lambda h: h.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("cos")).alias("d"), "other")))), 1, more).alias("l"))
    found = cut(best(hits)).select("id", F.explode("l").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("cos"))
    label = _hanging(found.where(F.col("cos") >= NEAR).select("id", "other"))
    sizes = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dealt = label.join(sizes, "label").select("id", "label", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("part"))
    whole = placed.select("id", "v").join(dealt, "id").repartition(parts(spark), "label", "part").sortWithinPartitions("label", "part", "id").select("label", "part", "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _runs(batches):
            x = unit(np.frombuffer(b"".join(v), np.float32).reshape(-1, dim))
            keep = min(more, len(ids) - 1)
            for at in range(0, len(x) if keep else 0, 256):
                cos = np.round(x[at : at + 256] @ x.T, digits)
                n = np.arange(len(cos))
                cos[n, at + n] = -9
                order = np.argsort(-cos, axis=1, kind="stable")[:, :keep]  # ids rise
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 256], keep)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(cos, order, 1).ravel())], names=["id", "other", "cos"])

    lists = best(found.unionByName(whole.mapInArrow(meet, "id long, other long, cos double")))
    near = points.select("id", "h").join(lists, "id", "left")
    # the smallest ids of every point: more than k of one point can't be in a list
    ranked = member.withColumn("_n", F.row_number().over(_by_h())).where(F.col("_n") <= more)
    smallest = ranked.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads_of = points.select(F.col("id").alias("other"), F.col("h").alias("oh")).join(smallest.select(F.col("h").alias("oh"), "ids"), "oh").select("other", "ids")
    entries = near.select("h", F.explode("l").alias("e")).select("h", F.col("e.d").alias("d"), F.col("e.other").alias("other")).join(heads_of, "other").select("h", "d", F.explode("ids").alias("o"))
    own = smallest.select("h", F.lit(-1.0).alias("d"), F.explode("ids").alias("o"))
    full = entries.unionByName(own).groupBy("h").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "o"))), 1, more).alias("l"))
    each = member.join(full, "h").select("id", F.slice(F.filter("l", lambda e: e["o"] != F.col("id")), 1, k).alias("l"))
    return each.select("id", F.posexplode("l").alias("rank", "e")).select("id", F.col("e.o").alias("other"), (-F.col("e.d")).alias("cos"), (F.col("rank") + 1).alias("rank"))


def _hanging(pairs: DataFrame) -> DataFrame:
    """(id, label): the smallest id that HOPS steps along pairs (id, other), either way, lead to."""
    both = cut(pairs.select("id", "other").unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    label = both.groupBy("id").agg(F.min("other").alias("o")).select("id", F.least("id", "o").alias("label"))
    for _ in range(HOPS - 1):
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("o"))
        label = cut(label.join(near, "id").select("id", F.least("label", "o").alias("label")))
    return label


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, vectors) of each run of equal (label, part)."""
    last, ids, vectors = None, [], []
    for b in batches:
        for key, i, v in zip(zip(b.column("label").to_pylist(), b.column("part").to_pylist()), b.column("id").to_pylist(), b.column("v").to_pylist()):
            if key != last and ids:
                yield np.array(ids, np.int64), vectors
                ids, vectors = [], []
            last = key
            ids.append(i)
            vectors.append(v)
    if ids:
        yield np.array(ids, np.int64), vectors


def _by_h():
    from pyspark.sql import Window

    return Window.partitionBy("h").orderBy("id")
