"""Edges between keys that share items, and their pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parts


#: Holders beyond which an item is hot: its pairs are no longer made one by one.
HOT = 2000

#: Mean number of items beside an item up to which whole lists travel with each of their items.
SHORT = 24

#: Holders of an item that a task compares with all of its holders.
SHARE = 1000

#: Keys and items held that make a group of dense_overlaps().
GROUP, HELD = 50_000, 6_000_000


def overlap_edges(pairs: DataFrame, left: str = "left", item: str = "item", min_shared: int = 3, with_members: bool = False, hot: int = HOT, short: int = SHORT, share: int = SHARE) -> DataFrame:
    """(a, b, w[, members]): keys a < b with at least min_shared common items; exact.

    Short lists travel whole: a pair with min_shared common items has its rarest one before the min_shared - 1 most frequent of either list, so it meets by
    those items only and is made where it meets by the rarest, without a shuffle of pairs; an item of more
    than `share` holders is dealt to several tasks. Where lists are long, pairs that share an ordinary item meet by an equi-join on it and are counted before the shuffle. Items of more than `hot` holders
    make no pairs of their own: a pair met by ordinary items gets its hot ones from the two short lists of hot items, and a pair that shares
    hot items only, min_shared of them, shares one that is not among either's min_shared - 1 hottest, so only the others are joined.
    Nulls have no edge, repeats count once.
    """
    flat = pairs.select(F.col(left).alias("l"), F.col(item).alias("i")).where(F.col("l").isNotNull() & F.col("i").isNotNull()).distinct()
    freq = flat.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    held = cut(flat.join(freq, "i"))
    lengths = held.groupBy("l").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s"), F.sum("k").alias("k")).first()
    if (lengths["s"] or 0) <= short * (lengths["k"] or 0) and min_shared > 0:
        lists = held.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("h")).where(F.size("h") >= min_shared)
        lists = lists.select("l", F.transform("h", lambda v: v["i"]).alias("h"))
        early = cut(lists.select("l", "h", F.explode(F.slice("h", F.lit(1), F.size("h") - (min_shared - 1))).alias("i")))
        sides = early.groupBy("i").agg(F.ceil(F.count("*") / share).cast("int").alias("s"))
        early, n = early.join(sides, "i"), parts(pairs.sparkSession)  # a number given is kept: by bytes, few tasks would get all pairs
        x = early.select(F.col("l").alias("a"), F.col("h").alias("ha"), "i", F.pmod(F.xxhash64("l"), F.col("s")).cast("int").alias("s")).repartition(n, "i", "s")
        y = early.select(F.col("l").alias("b"), F.col("h").alias("hb"), "i", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s")).repartition(n, "i", "s")
        common = x.join(y, ["i", "s"]).where(F.col("a") < F.col("b")).select("a", "b", "i", F.array_intersect("ha", "hb").alias("m"))
        got = common.where((F.size("m") >= min_shared) & (F.get("m", F.lit(0)) == F.col("i")))
        return got.select("a", "b", F.size("m").cast("long").alias("w"), *([F.array_sort("m").alias("members")] if with_members else []))
    cold = held.where(F.col("n") <= hot)
    x, y = cold.select(F.col("l").alias("a"), "i"), cold.select(F.col("l").alias("b"), "i")
    members = [F.collect_list("i").alias("m")] if with_members else []
    met = x.join(y, "i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("c"), *members)
    lists = held.where(F.col("n") > hot).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("h"))
    if lists.isEmpty():
        out = met.where(F.col("c") >= min_shared)
        return out.select("a", "b", F.col("c").alias("w"), *([F.array_sort("m").alias("members")] if with_members else []))
    lists = cut(lists.select("l", F.transform("h", lambda v: v["i"]).alias("h")))
    rest = lists.select("l", F.explode(F.slice("h", 1, F.greatest(F.size("h") - (min_shared - 1), F.lit(0)))).alias("i"))
    only = rest.select(F.col("l").alias("a"), "i").join(rest.select(F.col("l").alias("b"), "i"), "i").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    every = met.join(only, ["a", "b"], "full_outer")
    both = every.join(lists.select(F.col("l").alias("a"), F.col("h").alias("ha")), "a", "left").join(lists.select(F.col("l").alias("b"), F.col("h").alias("hb")), "b", "left")
    none = F.array().cast(lists.schema["h"].dataType)
    common = F.coalesce(F.array_intersect("ha", "hb"), none)
    w = F.coalesce("c", F.lit(0)) + F.size(common)
    got = [F.array_sort(F.concat(F.coalesce("m", none), common)).alias("members")] if with_members else []
    return both.select("a", "b", w.cast("long").alias("w"), *got).where(F.col("w") >= min_shared)


def coded_lists(pairs: DataFrame, min_shared: int, left: str = "left", item: str = "item") -> DataFrame:
    """(l, h): each key's items that others hold too, as 64-bit hashes, the rarest first, for keys of at least min_shared of them."""
    flat = pairs.select(F.col(left).alias("l"), F.xxhash64(item).alias("i")).where(F.col(left).isNotNull() & F.col(item).isNotNull()).distinct()
    freq = flat.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    h = flat.join(freq, "i").groupBy("l").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("h")).where(F.size("h") >= min_shared)
    return cut(h.select("l", F.transform("h", lambda v: v["i"]).alias("h")))


def edges_of(nodes: DataFrame, lists: DataFrame, min_shared: int) -> DataFrame:
    """(u, v): the edges of overlap_edges() at the nodes u, from coded_lists(); a pair is made where it meets by its rarest common item."""
    early = lambda t: t.select("l", "h", F.explode(F.slice("h", F.lit(1), F.size("h") - (min_shared - 1))).alias("i"))
    x = early(lists.join(nodes.select(F.col("node").alias("l")), "l", "left_semi")).select(F.col("l").alias("u"), F.col("h").alias("hu"), "i")
    y = early(lists).select(F.col("l").alias("v"), F.col("h").alias("hv"), "i")
    common = x.join(y, "i").where(F.col("u") != F.col("v")).select("u", "v", "i", F.array_intersect("hu", "hv").alias("m"))
    return common.where((F.size("m") >= min_shared) & (F.get("m", F.lit(0)) == F.col("i"))).select("u", "v")


def _packed(lists: DataFrame, groups: int) -> DataFrame:
    """(g, names, sizes, items, counts, holders): the lists (l, h) in groups, each a row with its names in order and its items with the places of their holders."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_ = [b for b in batches if len(b)]
        if not parts_:
            return
        t = pa.Table.from_batches(parts_)
        t = t.take(pc.sort_indices(t["l"]))
        h = t["h"].combine_chunks()
        sizes = pc.list_value_length(h).to_numpy().astype(np.int32)
        at = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 65536 else np.uint32), sizes)
        items, place, counts = np.unique(h.flatten().to_numpy(), return_inverse=True, return_counts=True)
        holders = at[np.argsort(place, kind="stable")]
        names = t["l"].combine_chunks()
        row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *[pa.array([x.tobytes()], pa.binary()) for x in (sizes, items, counts.astype(np.int32), holders)]]
        yield pa.RecordBatch.from_arrays(row, ["g", "names", "sizes", "items", "counts", "holders"])

    kind = lists.schema["l"].dataType.simpleString()
    return cut(lists.repartition(groups, "l").mapInArrow(pack, f"g int, names array<{kind}>, sizes binary, items binary, counts binary, holders binary"))


def _met(batches: Iterator[pa.RecordBatch], min_shared: int, least: int, flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(a, b, w, ca, cb) of two groups, or of one with itself: each key's items call up their holders, which are counted."""
    rows = sorted((r for b in batches for r in pa.Table.from_batches([b]).to_batches(1)), key=lambda r: r["g"][0].as_py())
    if len(rows) < (1 if rows and rows[0]["same"][0].as_py() else 2):  # of two groups, one may have no keys
        return
    bytes_ = lambda r, c, kind: np.frombuffer(r[c][0].as_buffer(), kind)
    names, sizes, items, counts, holders = zip(*[(r["names"].flatten(), bytes_(r, "sizes", np.int32), bytes_(r, "items", np.int64), bytes_(r, "counts", np.int32), bytes_(r, "holders", np.uint16 if len(r["names"].flatten()) <= 65536 else np.uint32)) for r in rows])
    x, y = 0, len(rows) - 1
    _, ix, iy = np.intersect1d(items[x], items[y], assume_unique=True, return_indices=True)
    seen = np.full(len(items[x]), -1)
    seen[ix] = np.arange(len(ix))
    ends = np.cumsum(counts[y])
    lists = [holders[y][i:j] for i, j in zip((ends - counts[y])[iy].tolist(), ends[iy].tolist())]
    which = np.repeat(seen, counts[x])
    keys, which = holders[x][which >= 0], which[which >= 0]
    which = which[np.argsort(keys, kind="stable")].tolist()
    stop = np.cumsum(np.bincount(keys, minlength=len(names[x]))).tolist()
    many = len(names[y])
    order = pc.sort_indices(pa.chunked_array([names[x], names[y]])).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rx, ry = rank[: len(names[x])], rank[len(names[x]) :]
    found: list = [[], [], []]

    def batch() -> pa.RecordBatch:
        p, q, w = (np.concatenate(f) for f in found)
        for f in found:
            f.clear()
        a, b, ca, cb = names[x].take(pa.array(p)), names[y].take(pa.array(q)), sizes[x][p].astype(np.int64), sizes[y][q].astype(np.int64)
        if x != y:
            swap = rx[p] > ry[q]
            a, b = pc.if_else(pa.array(swap), b, a), pc.if_else(pa.array(swap), a, b)
            ca, cb = np.where(swap, cb, ca), np.where(swap, ca, cb)
        return pa.RecordBatch.from_arrays([a, b, pa.array(w), pa.array(ca), pa.array(cb)], ["a", "b", "w", "ca", "cb"])

    enough, n, start = sizes[y] >= least, 0, 0
    for k, end in enumerate(stop):
        mine, start = which[start:end], end
        if len(mine) < min_shared or sizes[x][k] < least:
            continue
        c = np.bincount(np.concatenate([lists[i] for i in mine]), minlength=many)
        if x == y:
            c[: k + 1] = 0
        hit = np.flatnonzero((c >= min_shared) & enough)
        if len(hit):
            found[0].append(np.full(len(hit), k))
            found[1].append(hit)
            found[2].append(c[hit])
            n += len(hit)
        if n >= flush:
            yield batch()
            n = 0
    if n:
        yield batch()


def dense_overlaps(pairs: DataFrame, left: str = "left", item: str = "item", min_shared: int = 3, least: int = 1, group: int = GROUP, held: int = HELD) -> tuple[DataFrame, int]:
    """((a, b, w, ca, cb), n): as overlap_edges(), for long lists of which a good part of all pairs have common items; ca and cb are the keys' numbers of items,
    n the number of items. Keys of fewer than `least` items have no edge, but their items count in n.

    No pair is shuffled: keys are dealt to groups of some `group` keys and `held` items, a task meets two groups and counts all pairs of them, so memory is bounded by the groups and the
    lists are sent once for each group. Work is that of the pairs by items and of all pairs of keys. Items that are no whole numbers meet by 64-bit hashes.
    """
    if min_shared < 1:
        raise ValueError("pairs without common items are not made")
    whole = pairs.schema[item].dataType.typeName() in ("byte", "short", "integer", "long")
    code = F.col(item).cast("long") if whole else F.xxhash64(item)
    lists = cut(pairs.where(F.col(left).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(left).alias("l")).agg(F.collect_set(code).alias("h")))
    size = lists.agg(F.count("*").alias("k"), F.sum(F.size("h")).alias("s")).first()
    groups = max(1, -(-size["k"] // group), -(-(size["s"] or 0) // held))
    packed = _packed(lists, groups)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["items"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], ["i"])

    n = packed.select("items").mapInArrow(unpack, "i long").distinct().count()
    i, j = F.least("g", "o"), F.greatest("g", "o")
    cells = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("*", (j * (j + 1) / 2 + i).cast("int").alias("cell"), (F.col("g") == F.col("o")).alias("same"))
    kind = pairs.schema[left].dataType.simpleString()
    out = cells.drop("o").repartitionById(groups * (groups + 1) // 2, "cell").drop("cell").mapInArrow(lambda batches: _met(batches, min_shared, least), f"a {kind}, b {kind}, w long, ca long, cb long")
    return out, n


def both_ways(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(node, other, w): each undirected edge from both ends."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"), F.col(weight).alias("w")).select(
        "e.node", "e.other", "w"
    )


def _ranked(edges: DataFrame, k: int, weight: str) -> DataFrame:
    """(a, b, hits): edges in the top k of one or both ends; neighbours by weight, then name, both falling."""
    w = Window.partitionBy("node").orderBy(F.col("w").desc(), F.col("other").desc())
    top = both_ways(edges, weight).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count("*").alias("hits"))


def prune_either(edges: DataFrame, k: int = 4, weight: str = "w") -> DataFrame:
    """Edges (a < b) that are among the k strongest of either end."""
    return edges.join(_ranked(edges, k, weight), ["a", "b"], "left_semi")


def prune_mutual(edges: DataFrame, k: int = 20, weight: str = "w") -> DataFrame:
    """Edges (a < b) that are among the k strongest of both ends."""
    return edges.join(_ranked(edges, k, weight).where(F.col("hits") == 2), ["a", "b"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of directed edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def weighted_degrees(edges: DataFrame, weight: str = "w") -> DataFrame:
    return both_ways(edges, weight).groupBy("node").agg(F.sum("w").alias("degree"))


def prune_directed(edges: DataFrame, k: int = 4) -> DataFrame:
    """Directed edges among a source's k targets of greatest in-degree or a target's k sources of greatest out-degree."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("b"), F.col("in_degree").alias("_in")), "b").join(d.select(F.col("node").alias("a"), F.col("out_degree").alias("_out")), "a")
    ra = F.row_number().over(Window.partitionBy("a").orderBy(F.col("_in").desc(), F.col("b").desc()))
    rb = F.row_number().over(Window.partitionBy("b").orderBy(F.col("_out").desc(), F.col("a").desc()))
    return e.withColumn("_ra", ra).withColumn("_rb", rb).where((F.col("_ra") <= k) | (F.col("_rb") <= k)).select(*edges.columns)


def _held(refs: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct (l, i), the rows of a key together: windows and joins by key after it need no shuffle of their own, and plans that read it twice share one."""
    return refs.select(F.col(key).alias("l"), F.col(item).alias("i")).where(F.col("l").isNotNull() & F.col("i").isNotNull()).repartition("l").distinct()


def sketch_candidates(refs: DataFrame, key: str = "origin", item: str = "object_id", width: int = 96, most_holders: int = 40) -> DataFrame:
    """(a, b): keys that share one of their `width` smallest items; items held by more than most_holders keys are passed over.

    That bound is the operator's own: a candidate search that exact verification follows.
    """
    flat = _held(refs, key, item)
    small = flat.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("i"))).where(F.col("r") <= width)
    held = small.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_holders))
    use = small.join(held, "i").select("l", "i")
    return use.select(F.col("l").alias("a"), "i").join(use.select(F.col("l").alias("b"), "i"), "i").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def containment(candidates: DataFrame, refs: DataFrame, key: str = "origin", item: str = "object_id") -> DataFrame:
    """(a, b, shared, size_a, size_b, containment, jaccard) of candidate pairs, exact. Only the items of their keys meet."""
    ends = candidates.select(F.explode(F.array("a", "b")).alias("l")).distinct()
    flat = _held(refs, key, item).join(ends, "l", "left_semi")
    n = flat.groupBy("l").agg(F.count("*").alias("n"))
    shared = (
        candidates.join(flat.select(F.col("l").alias("a"), "i"), "a").join(flat.select(F.col("l").alias("b"), "i"), ["b", "i"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    )
    full = candidates.join(shared, ["a", "b"], "left").join(n.select(F.col("l").alias("a"), F.col("n").alias("size_a")), "a").join(n.select(F.col("l").alias("b"), F.col("n").alias("size_b")), "b")
    s = F.coalesce("shared", F.lit(0))
    return full.select("a", "b", s.alias("shared"), "size_a", "size_b", (s / F.least("size_a", "size_b")).alias("containment"), (s / (F.col("size_a") + F.col("size_b") - s)).alias("jaccard"))


def same_by_containment(pairs: DataFrame, min_shared: int = 2, least: float = 0.9) -> DataFrame:
    return pairs.where((F.col("shared") >= min_shared) & (F.col("containment") >= least))


def folded(sources: list[DataFrame], coordinate: str = "coord") -> DataFrame:
    """(a, b, w, coords): edges of several sources as one, the weight the number of distinct coordinates."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s)
    return whole.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.array_sort(F.collect_set(coordinate)).alias("coords")).select("a", "b", F.size("coords").cast("long").alias("w"), "coords")


def cosine_edges(vectors: DataFrame, key: str, vector: str, at_least: float, block: int = 512) -> DataFrame:
    """(a, b, w): all pairs a < b of cosine >= at_least (a zero norm counts as 1), by blocks of rows against blocks.

    Rows are dealt to blocks; a task multiplies two blocks as matrices, so memory is bound by the block and the exact quadratic work is
    spread evenly. Vectors that are null, or have nulls or another length than the first of their block, are left out by `usable`.
    """
    import numpy as np
    import pandas as pd

    ok = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    n = ok.count()
    blocks = max(1, -(-n // block))
    dealt = ok.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    sent = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).cast("int").alias("side"), "k", "v")
    kind = vectors.schema[key].dataType.simpleString()

    def multiply(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key_
        x = pdf[pdf["side"] == 0]
        y = pdf[pdf["side"] == 1] if i != j else x
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "w": []})
        mx, my = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        nx, ny = np.linalg.norm(mx, axis=1), np.linalg.norm(my, axis=1)
        nx[nx == 0], ny[ny == 0] = 1, 1
        c = (mx / nx[:, None]) @ (my / ny[:, None]).T
        kx, ky = x["k"].to_numpy(), y["k"].to_numpy()
        p, q = np.nonzero(c >= at_least)
        a, b, w = kx[p], ky[q], c[p, q]
        keep = (a < b) if i == j else (a != b)
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"a": a[keep], "b": b[keep], "w": w[keep]})

    return sent.groupBy("i", "j").applyInPandas(multiply, f"a {kind}, b {kind}, w double")
