"""All pairs of sets with a Jaccard similarity of at least t, by recursive chosen-path splitting."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Words of the parity sketch; sets of a large node to which its sets are compared; comparisons of one task.
SKETCH, PIVOTS, MEETINGS = 4, 2, 5_000_000
#: Splits after which large nodes are searched for near copies.
SPLITS = 2
#: Large nodes up to which their list is broadcast; beyond, rows are shuffled to it.
FEW = 100_000


def clean_items(items: Column) -> Column:
    """Sorted distinct values without outer blanks and case; null and blank ones go. Null for a null array."""
    low = F.transform(items, lambda x: F.lower(F.regexp_replace(x, r"^[\s\x00-\x20 　]+|[\s\x00-\x20 　]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: x.isNotNull() & (x != ""))))


def _sketch(tokens: str, words: int = SKETCH) -> Column:
    """Parity of the tokens in 64 * words cells: the sketches of two sets differ in no more cells than the sets in tokens."""
    zero = F.array(*[F.lit(0).cast("long")] * words)
    return F.aggregate(
        tokens,
        zero,
        lambda acc, t: F.transform(
            acc, lambda w, i: F.when(F.pmod(F.shiftrightunsigned(t, 6), F.lit(words)) == i, w.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(64)).cast("int")))).otherwise(w)
        ),
    )


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _branches(branch: int, keep: list[str]):
    """Each row's ways down: its `branch` smallest tokens by a hash of node and token, which is the next node; the path grows by the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("_t").offsets.to_numpy().astype(np.int64)
            tokens = b.column("_t").values.to_numpy().view(np.uint64)[: at[-1]]
            size = np.diff(at)
            live = np.flatnonzero(size)
            if not len(live):
                continue
            h = _mix(tokens ^ np.repeat(_mix(b.column("_node").to_numpy().view(np.uint64)), size))
            owner, open_, places = np.repeat(np.arange(len(live)), size[live]), h.copy(), []
            for k in range(branch):
                least = np.minimum.reduceat(open_, at[:-1][live])
                here = np.flatnonzero(open_ == least[owner])
                here = here[np.unique(owner[here], return_index=True)[1]]
                open_[here] = np.uint64(0xFFFFFFFFFFFFFFFF)
                places.append(here[size[live] > k])
            place = np.concatenate(places)
            row = live[owner[place]]
            path = b.column("_path").flatten().to_numpy().reshape(len(b), -1)[row]  # of one length on a level
            path = np.hstack([path, tokens[place].view(np.int64)[:, None]])
            ends = pa.array(np.arange(len(row) + 1, dtype=np.int32) * path.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(row)) for c in keep), pa.ListArray.from_arrays(ends, pa.array(path.reshape(-1))), pa.array(h[place].view(np.int64))], names=[*keep, "_path", "_node"]
            )

    return run


def _brute(threshold: float):
    """Rows (node, class, size, sketch words), by node: the pairs of classes of a node whose sizes and sketches fit. A node's rows are few."""
    apart = (1 - threshold) / (1 + threshold)

    def pairs(x: np.ndarray) -> list[np.ndarray]:
        node, c, n, w = x[:, 0], x[:, 1], x[:, 2], np.ascontiguousarray(x[:, 3:]).view(np.uint64)
        ends = np.flatnonzero(np.append(node[1:] != node[:-1], True)) + 1
        after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(node)) - 1  # rows of the same node that follow
        out, step, i = [], 1, np.flatnonzero(after > 0)
        while len(i):
            j = i + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fit = (small >= large * threshold - 1e-9) & (c[i] != c[j])
            p, q = i[fit], j[fit]
            differ = np.bitwise_count(w[p] ^ w[q]).sum(axis=1, dtype=np.int64)
            fit = differ <= (n[p] + n[q]) * apart + 1e-9
            p, q = c[p[fit]], c[q[fit]]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
            step += 1
            i = i[after[i] >= step]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3 + SKETCH), np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rest = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)])
            # the last node may go on in the next batch
            cut_at = len(rest) if b is None else int(np.searchsorted(rest[:, 0], rest[-1, 0])) if len(rest) else 0
            out = pairs(rest[:cut_at]) if cut_at else []
            rest = rest[cut_at:]
            if out:
                got = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["p", "q"])

    return run


def similar_pairs(
    sets: DataFrame,
    key: str,
    items: str,
    threshold: float = 0.7,
    scope: str | None = None,
    trees: int = 6,
    branch: int = 3,
    leaf: int = 48,
    max_depth: int = 24,
    seed: int = 11,
) -> DataFrame:
    """(a, b): all pairs of different keys, a < b, of the same scope with Jaccard >= threshold; exact values, targeted recall.

    Copies of a set are one class, paired at the end. In each of `trees` trees a class goes down the paths of its `branch` smallest tokens by a
    hash of (tree, path, token): similar sets mostly choose a common token. Nodes of one class end, nodes of at most `leaf`
    are compared by brute force, larger ones split again on tokens not yet on the path. The next token of a pair at threshold t is
    common with a chance over 1 - (1 - t)^branch, 0.97 for t = 0.7 and 3, and a pair has up to `branch` ways down: trees fail together
    with less than 1e-6 at the depths met in practice. The comparison filters by size and by the parity sketches (the
    symmetric difference of similar sets is small), and survivors are verified on the sets themselves.

    A token that a third of all sets hold makes a large node, which is only a reason to split it further by tokens that differ:
    it is never paired. Sets that a large node's path already makes similar (their tokens off the path are so few that the path alone reaches
    the threshold) are met there, which makes true pairs only. Splitting does not part near copies: where a quarter or more of a node
    that is still large after SPLITS splits is similar to one of PIVOTS of its sets, those are compared with the whole node, on salted tasks, and leave it; what
    remains is split.

    Cases: null keys, null and empty sets have no pair; of rows with equal key and different sets each stands for itself, and a key is never paired with itself;
    repeated rows change nothing; an empty table gives no rows; extra columns are ignored.
    """
    part = F.col(scope) if scope else F.lit("")
    src = sets.select(part.alias("_s"), F.col(key).alias("_k"), F.col(items).alias("_i")).where(F.col("_k").isNotNull() & (F.size("_i") > 0))
    src = src.select("*", F.xxhash64("_s", F.array_join("_i", "\x01"), F.size("_i")).alias("_c"))
    member = src.select("_s", "_k", "_c").distinct()
    classes = cut(
        src.groupBy("_c").agg(F.first(F.struct("_s", "_i")).alias("x")).select(
            "_c", F.col("x._s").alias("_s"), F.col("x._i").alias("_i"), F.transform("x._i", lambda t: F.xxhash64(t)).alias("_t")
        )
    )
    light = classes.select("_c", F.size("_t").alias("_n"), "_t", _sketch("_t").alias("_w"), F.xxhash64("_s").alias("_s"))
    light = light.select("_c", "_n", "_t", *[F.col("_w")[i].alias(f"_w{i}") for i in range(SKETCH)], "_s")
    keep = ["_c", "_n", *[f"_w{i}" for i in range(SKETCH)]]
    row = ", ".join(f"{c} {light.schema[c].dataType.simpleString()}" for c in keep) + ", _path array<bigint>, _node bigint"
    tokens_of = light.select("_c", "_t")
    level = light.select(*keep, "_t", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("_tree"), "_s").select(
        *keep, "_t", F.array().cast("array<long>").alias("_path"), F.xxhash64("_s", "_tree", F.lit(seed)).alias("_node")
    )
    apart = (1 - threshold) / (1 + threshold)

    def near(x: str, y: str) -> Column:
        """What the sizes and sketches of similar sets fulfil; the columns' names end in x and y."""
        differ = sum((F.bit_count(F.col(f"_w{i}{x}").bitwiseXOR(F.col(f"_w{i}{y}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"_w0{x}").bitwiseXOR(F.col(f"_w0{y}"))))
        nx, ny = F.col(f"_n{x}"), F.col(f"_n{y}")
        return (nx * F.lit(1.0) >= ny * threshold - 1e-9) & (ny * F.lit(1.0) >= nx * threshold - 1e-9) & (differ <= (nx + ny) * apart + 1e-9)

    def named(df: DataFrame, end: str, *more: str) -> DataFrame:
        return df.select("_node", *more, *[F.col(c).alias(f"{c}{end}") for c in keep])

    def meet(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
        return x.join(y, ["_node", *on]).where((F.col("_cx") != F.col("_cy")) & near("x", "y")).select(F.least("_cx", "_cy").alias("p"), F.greatest("_cx", "_cy").alias("q"))

    leaves: list[DataFrame] = []
    sure: list[DataFrame] = []
    for depth in range(max_depth):
        # what goes down has its path, not its tokens: few rows are in large nodes, and only these fetch them again
        down = cut(level.select(*keep, "_t", "_path", "_node").mapInArrow(_branches(branch, keep), row))
        hot = cut(down.groupBy("_node").agg(F.count("*").alias("_m")).where(F.col("_m") > leaf))
        large = hot.count()
        if not large:
            leaves.append(down.select("_node", *keep))
            break
        hot = F.broadcast(hot) if large <= FEW else hot  # rows of 16 bytes
        leaves.append(down.join(hot.select("_node"), "_node", "left_anti").select("_node", *keep))
        stay = down.join(hot.select("_node"), "_node", "left_semi")
        left = F.col("_n") - (depth + 1)
        spare = int((depth + 1) * (1 - threshold) / threshold + 1e-9)
        if spare:  # the path alone is enough for those with so few tokens off it
            few = stay.where(left <= spare).select("_node", F.col("_c").alias("p"), left.alias("rp"))
            too = few.select("_node", F.col("p").alias("q"), F.col("rp").alias("rq"))
            sure.append(few.join(too, "_node").where((F.col("p") < F.col("q")) & (F.col("rp") + F.col("rq") <= spare)).select("p", "q"))
        split = stay.where(left > 0)
        level = split.join(tokens_of, "_c")
        if depth < SPLITS:  # most nodes are parted by the first splits
            level = level.select(*keep, F.array_except("_t", "_path").alias("_t"), "_path", "_node")
            continue
        # pivots: the sets of the least hashes; sketches tell where one may be similar to many, tokens where it is
        of = [F.min_by("_c", F.xxhash64("_c", F.lit(seed + k))) for k in range(1, PIVOTS + 1)]
        pivots = split.groupBy("_node").agg(F.array_distinct(F.array(*of)).alias("_v")).select("_node", F.explode("_v").alias("_c")).join(light.select(*keep), "_c")
        alike = named(split, "x").join(named(pivots, "v"), "_node").where(near("x", "v")).groupBy("_node", "_cv").agg(F.count("*").alias("_b"))
        dense = cut(alike.join(hot, "_node").where(F.col("_b") * 4 >= F.col("_m")).select("_node", "_cv", "_m"))
        if not dense.isEmpty():
            centres = dense.join(light.select(*[F.col(c).alias(f"{c}v") for c in keep], F.col("_t").alias("_tv")), "_cv")
            common = F.size(F.array_intersect("_t", "_tv"))
            balls = named(level.join(dense.select("_node").distinct(), "_node"), "x", "_t").join(centres, "_node").where(near("x", "v") & (common >= F.lit(threshold) * (F.col("_nx") + F.col("_nv") - common) - 1e-9))
            balls = cut(balls.select("_node", "_cv", "_m", *[f"{c}x" for c in keep]))
            dense = balls.groupBy("_node", "_cv", "_m").agg(F.count("*").alias("_b")).where(F.col("_b") * 4 >= F.col("_m"))
            dense = cut(dense.groupBy("_node").agg(F.max_by("_cv", F.struct("_b", "_cv")).alias("_cv"), F.max(F.floor(F.col("_b") * F.col("_m") / MEETINGS)).alias("_salts")))
            ball = balls.join(dense, ["_node", "_cv"]).select("_node", "_salts", *[f"{c}x" for c in keep])
            x = ball.select("*", F.explode(F.sequence(F.lit(0), "_salts")).alias("_salt")).drop("_salts")
            y = named(stay.join(dense.select("_node", "_salts"), "_node").withColumn("_salt", F.pmod(F.xxhash64("_c"), F.col("_salts") + 1)), "y", "_salt")
            sure.append(meet(x, y, "_salt"))
            level = level.join(ball.select("_node", F.col("_cx").alias("_c")), ["_node", "_c"], "left_anti")
        level = level.select(*keep, F.array_except("_t", "_path").alias("_t"), "_path", "_node")
    else:
        rest = cut(level.select("_node", *keep))  # what depth could not split is compared as it is
        sure.append(meet(named(rest, "x"), named(rest, "y")).where("p < q"))
    flat = leaves[0]
    for more in leaves[1:]:
        flat = flat.unionByName(more)
    met = flat.repartition("_node").sortWithinPartitions("_node").mapInArrow(_brute(threshold), "p long, q long")
    for more in sure:
        met = met.unionByName(more)
    met = met.distinct()
    px = classes.select(F.col("_c").alias("p"), F.col("_s").alias("sp"), F.col("_i").alias("ip"))
    qx = classes.select(F.col("_c").alias("q"), F.col("_s").alias("sq"), F.col("_i").alias("iq"))
    inter = F.size(F.array_intersect("ip", "iq"))
    good = met.join(px, "p").join(qx, "q").where(
        (F.col("sp") == F.col("sq")) & (inter >= F.lit(threshold) * (F.size("ip") + F.size("iq") - inter) - 1e-9)
    ).select("p", "q")
    links = cut(good.unionByName(classes.select(F.col("_c").alias("p"), F.col("_c").alias("q"))))
    a = member.select(F.col("_c").alias("p"), F.col("_s"), F.col("_k").alias("_ka"))
    b = member.select(F.col("_c").alias("q"), F.col("_k").alias("_kb"))
    pairs = links.join(a, "p").join(b, "q").where((F.col("_ka") != F.col("_kb")) & ((F.col("p") != F.col("q")) | (F.col("_ka") < F.col("_kb"))))
    out = pairs.select(*([F.col("_s").alias(scope)] if scope else []), F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"))
    return out.distinct()
