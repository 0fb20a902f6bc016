"""Overlap sizes between many large sets, by partitioned compressed bitmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, running_sum

#: Identifiers of one range; a set's part of a range is a container: sorted 16-bit offsets, or from DENSE of them on a bitmap.
RANGE_BITS, DENSE = 16, 4096
BITMAP = (1 << RANGE_BITS) // 8
#: Sets of one block; bytes of the containers that two blocks have in one lane of ranges, so what a task holds is bounded whatever the sizes of sets.
BLOCK, LANE_BYTES, PER_BOX = 256, 32 << 20, 64


def pack(low: np.ndarray) -> bytes:
    low = np.asarray(low, np.uint16)
    if len(low) < DENSE:
        return low.tobytes()
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if len(b) < BITMAP:
        return np.frombuffer(b, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.uint16)


def _grid(rows: np.ndarray, boxes: list[bytes], n: int) -> np.ndarray:
    """(n, words) bitmaps of a whole range."""
    out = np.zeros((n, BITMAP), np.uint8)
    for r, b in zip(rows.tolist(), boxes):
        if len(b) < BITMAP:
            bits = np.zeros(1 << RANGE_BITS, bool)
            bits[np.frombuffer(b, np.uint16)] = True
            out[r] = np.packbits(bits)
        else:
            out[r] = np.frombuffer(b, np.uint8)
    return out.view(np.uint64)


def _grids(left: pd.DataFrame, right: pd.DataFrame, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bitmaps of both blocks over one range; where it is sparse only the identifiers that both hold get a place."""
    side = [(np.searchsorted(names, p["_set"].to_numpy()), list(p["_bits"]), len(names)) for p, names in ((left, xs), (right, ys))]
    if any(len(b) >= BITMAP for _, boxes, _ in side for b in boxes):
        return _grid(*side[0]), _grid(*side[1])
    flat = []
    for rows, boxes, n in side:
        bits = [unpack(b) for b in boxes]
        flat.append((np.repeat(rows, [len(b) for b in bits]), np.concatenate(bits), n))
    common = np.intersect1d(flat[0][1], flat[1][1])
    if not len(common):
        return None
    out = []
    for rows, cols, n in flat:
        at = np.searchsorted(common, cols)
        at[at == len(common)] = 0
        ok = common[at] == cols
        m = np.zeros((n, -(-len(common) // 64) * 64), bool)
        m[rows[ok], at[ok]] = True
        out.append(np.packbits(m, axis=1).view(np.uint64))
    return out[0], out[1]


def _meet(key: tuple, a: pd.DataFrame) -> pd.DataFrame:
    """Counts of common identifiers of each set of one block with each of another, over the ranges of a lane."""
    bi, bj, _ = key
    left, right = a[a["_side"] == 0], (a[a["_side"] == 1] if bi != bj else a[a["_side"] == 0])
    xs, ys = np.unique(left["_set"].to_numpy()), np.unique(right["_set"].to_numpy())
    total = np.zeros((len(xs), len(ys)), np.int64)
    right_of = dict(list(right.groupby("_range")))
    for r, part in left.groupby("_range"):
        other = right_of.get(r)
        met = _grids(part, other, xs, ys) if other is not None else None
        if met is None:
            continue
        x, y = met
        for i in np.flatnonzero(x.any(axis=1)).tolist():
            total[i] += np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
    i, j = np.nonzero(np.triu(total, 1) if bi == bj else total)
    return pd.DataFrame({"x": xs[i], "y": ys[j], "n": total[i, j]})


def overlaps(members: DataFrame, set_key: str, member: str) -> DataFrame:
    """(a, b, common, size_a, size_b): exact overlap sizes, a < b, of all pairs of sets with a common member.

    Members are numbered by falling frequency, so hot members share the first ranges, where bitmaps are dense, and the long tail
    is sparse arrays; members of one set only count for sizes. Sets are numbered and dealt to blocks; a task holds the containers of two
    blocks over a lane of ranges, of a bounded size, ands their bitmaps and emits counts, so a member that a third of all sets hold costs bits, not pairs of rows.
    Counts are summed over lanes.

    Cases: null sets and members are dropped; repeated rows count once; sets without members have no row; pairs without a common member have
    none; an empty table gives no rows; extra columns are ignored.
    """
    flat = cut(members.select(F.col(set_key).alias("_k"), F.col(member).alias("_m")).where(F.col("_k").isNotNull() & F.col("_m").isNotNull()).distinct())
    sizes = cut(flat.groupBy("_k").agg(F.count("*").alias("size")).withColumn("_one", F.lit(1)))
    numbered = running_sum(sizes, [], [F.col("_k")], "_one", "_set").select("_k", "size", (F.col("_set") - 1).cast("int").alias("_set"))
    numbered = cut(numbered)
    freq = flat.groupBy("_m").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).withColumn("_one", F.lit(1))
    ids = running_sum(freq, [], [-F.col("_n"), F.col("_m")], "_one", "_id").select("_m", (F.col("_id") - 1).alias("_id"))
    held = flat.join(ids, "_m").join(numbered.select("_k", "_set"), "_k")
    boxes = held.groupBy("_set", F.shiftright("_id", RANGE_BITS).alias("_range")).agg(
        F.array_sort(F.collect_list(F.col("_id").bitwiseAND((1 << RANGE_BITS) - 1).cast("int"))).alias("_low")
    )

    def packed(batches):
        for b in batches:
            yield b[["_set", "_range"]].assign(_bits=[pack(x) for x in b["_low"]])

    boxes = cut(boxes.mapInPandas(packed, "_set int, _range long, _bits binary"))
    blocks = -(-max(1, numbered.count()) // BLOCK)
    # ranges are cut into lanes where the containers of two blocks may reach LANE_BYTES: a range weighs what its largest block holds there
    mine = F.floor(F.col("_set") / BLOCK).cast("int")
    weight = boxes.groupBy("_range", mine.alias("_b")).agg(F.sum(F.length("_bits") + PER_BOX).alias("_w")).groupBy("_range").agg(F.max("_w").alias("_w"))
    lanes = running_sum(weight, [], [F.col("_range")], "_w", "_upto").select("_range", F.floor((F.col("_upto") - F.col("_w")) / (LANE_BYTES // 2)).cast("int").alias("_lane"))
    dealt = boxes.join(lanes, "_range").select("*", mine.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    dealt = dealt.select(
        F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_lane", (F.col("_b") > F.col("_o")).cast("int").alias("_side"), "_set", "_range", "_bits"
    )
    counts = dealt.groupBy("_i", "_j", "_lane").applyInPandas(_meet, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("common"))
    a = numbered.select(F.col("_set").alias("x"), F.col("_k").alias("_ka"), F.col("size").alias("_sa"))
    b = numbered.select(F.col("_set").alias("y"), F.col("_k").alias("_kb"), F.col("size").alias("_sb"))
    both = counts.join(a, "x").join(b, "y")
    low = F.col("_ka") < F.col("_kb")
    return both.select(
        F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), "common", F.when(low, F.col("_sa")).otherwise(F.col("_sb")).alias("size_a"), F.when(low, F.col("_sb")).otherwise(F.col("_sa")).alias("size_b")
    )
