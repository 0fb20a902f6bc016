"""Angles, heights and positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, parts
from .graph import DENSE, largest_nodes
from .overlap import both_ways


def circular_mean(df: DataFrame, key: str, theta: str, weight: str) -> DataFrame:
    """(key, theta, r): the weighted mean direction and its length; theta null and r 0 without a measured angle or with no weight."""
    w, t = F.when(F.col(theta).isNotNull(), F.col(weight)), F.col(theta)
    s = df.groupBy(key).agg(F.sum(w * F.cos(t)).alias("_x"), F.sum(w * F.sin(t)).alias("_y"), F.sum(w).alias("_w"))
    ok = F.col("_w").isNotNull() & (F.col("_w") != 0)
    return s.select(key, F.when(ok, F.atan2("_y", "_x")).alias("theta"), F.when(ok, F.hypot("_x", "_y") / F.col("_w")).otherwise(0.0).alias("r"))


def repo_angles(tags: DataFrame, topic_theta: DataFrame, repo: str = "repo", topic: str = "topic") -> DataFrame:
    """(repo, theta, r): circular mean of the angles of a repository's topics, weighted by ln(repositories / repositories with the topic)."""
    flat = tags.select(repo, topic).where(F.col(topic).isNotNull()).distinct()
    n = flat.select(F.countDistinct(repo).alias("_n"))
    idf = flat.groupBy(topic).agg(F.count("*").alias("_c")).crossJoin(n).select(topic, F.log(F.col("_n") / F.col("_c")).alias("idf"))
    return circular_mean(flat.join(idf, topic).join(topic_theta.select(topic, "theta"), topic, "left"), repo, "theta", "idf")


def resultant(df: DataFrame, group: str, theta: str, least: int = 2) -> DataFrame:
    """(group, members, length): how far the members of a group point the same way, for groups of at least `least` measured ones."""
    ok = df.where(F.col(theta).isNotNull())
    return ok.groupBy(group).agg(F.count("*").alias("members"), (F.hypot(F.sum(F.cos(theta)), F.sum(F.sin(theta))) / F.count("*")).alias("length")).where(F.col("members") >= least)


def weighted_resultant(df: DataFrame, group: str, theta: str) -> DataFrame:
    """(groups, members, mean_length): the mean of the groups' lengths by members."""
    r = resultant(df, group, theta)
    return r.agg(F.count("*").alias("groups"), F.sum("members").alias("members"), (F.sum(F.col("members") * F.col("length")) / F.sum("members")).alias("mean_length"))


def compared_sources(first: DataFrame, second: DataFrame, clusters: DataFrame, key: str = "repo") -> DataFrame:
    """(source, scope, groups, members, mean_length) of two sources of angles, each over all it covers and over what both cover."""
    a, b = first.where("theta is not null").select(key, "theta"), second.where("theta is not null").select(key, "theta")
    both = a.select(key).intersect(b.select(key))
    out = None
    for name, t in (("first", a), ("second", b)):
        for scope, s in (("all", t), ("shared", t.join(both, key, "left_semi"))):
            row = weighted_resultant(s.join(clusters, key), "cluster", "theta").select(F.lit(name).alias("source"), F.lit(scope).alias("scope"), "*")
            out = row if out is None else out.unionByName(row)
    return out


#: Nodes up to which the iterated vectors are on the driver (36 numbers a node), and ends of edges in a packed row.
HELD, PACK = 200_000, 2_000_000


def spectral(edges: DataFrame, normalised: bool = True, dense: int = DENSE, rounds: int = 150, held: int = HELD) -> DataFrame:
    """(node, theta, r): angle and radius of the second and third smallest eigenvectors of the Laplacian of the largest component.

    normalised solves L v = lambda D v, in which hubs keep their coordinates; r is the radius scaled to [0, 1]. Directions are fixed up to the
    eigenvectors' own freedom: the first entry of each, in node order, that is not 0 is positive. Up to `dense` nodes numpy solves it on the driver; beyond, LOBPCG
    until both residuals are small; not reaching that in `rounds` is an error. Up to `held` nodes its vectors are on the driver and a round is one pass over packed edges, without
    a shuffle; for more, all is in tables, one join and one sum a round.
    """
    inside = cut(largest_nodes(edges))
    n = inside.count()
    kind = edges.schema["a"].dataType.simpleString()
    if n < 3:
        return edges.sparkSession.createDataFrame([], f"node {kind}, theta double, r double")
    if dense < n <= held:
        xy = _packed(edges, inside, normalised, rounds)
    else:
        of = edges.join(inside.select(F.col("node").alias("a")), "a", "left_semi")
        e = cut(of.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").cast("double").alias("w")))
    if n > max(dense, held):
        xy = _iterated(e, normalised, rounds)
    elif n <= dense:
        names = [r["node"] for r in inside.orderBy("node").collect()]
        at = {x: i for i, x in enumerate(names)}
        w = np.zeros((n, n))
        for r in e.collect():
            w[at[r["a"]], at[r["b"]]] = w[at[r["b"]], at[r["a"]]] = r["w"]
        d = w.sum(1)
        lap = np.diag(d) - w
        if normalised:
            s = 1 / np.sqrt(d)
            vec = np.linalg.eigh(s[:, None] * lap * s[None, :])[1] * s[:, None]
        else:
            vec = np.linalg.eigh(lap)[1]
        xy = edges.sparkSession.createDataFrame([(names[i], float(vec[i, 1]), float(vec[i, 2])) for i in range(n)], f"node {kind}, x double, y double")
    lead = xy.agg(*[F.min_by(c, F.when(F.abs(c) > 1e-9, F.col("node"))).alias(f"_{c}") for c in "xy"])
    turned = xy.crossJoin(lead).select("node", *[F.when(F.col(f"_{c}") < 0, -F.col(c)).otherwise(F.col(c)).alias(c) for c in "xy"])
    polar = turned.select("node", F.atan2("y", "x").alias("theta"), F.hypot("x", "y").alias("_r"))
    span = polar.agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    r = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col("_r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return polar.crossJoin(span).select("node", "theta", r.alias("r"))


def _ritz(gram: np.ndarray, im: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, X, P): the Rayleigh-Ritz step in the part of the columns' span that is orthogonal to t, the last column: the m smallest values, and what makes the new
    X and P of the columns X, W, P, t; gram: the columns' products, im: those with their images."""
    out = np.vstack([np.eye(3 * m), -gram[-1:, :-1] / gram[-1, -1]])
    g, h = out.T @ gram @ out, out.T @ ((im + im.T) / 2) @ out
    size = np.sqrt(np.maximum(np.diag(g), 0))
    live = size > 1e-150
    scale = np.where(live, 1 / np.where(live, size, 1), 0)
    val, vec = np.linalg.eigh(g * scale[:, None] * scale[None, :])
    use = val > 1e-11
    base = scale[:, None] * vec[:, use] / np.sqrt(val[use])
    val, vec = np.linalg.eigh(base.T @ h @ base)
    coef = np.zeros((3 * m, m))
    k = min(m, len(val))
    coef[:, :k] = base @ vec[:, :k]
    lam = np.zeros(m)
    lam[:k] = val[:k]
    rest = coef.copy()
    rest[:m] = 0
    return lam, out @ coef, out @ rest


def _packed(edges: DataFrame, inside: DataFrame, normalised: bool, rounds: int, tol: float = 1e-5, block: int = 6, pack: int = PACK) -> DataFrame:
    """(node, x, y): as _iterated(), for nodes whose vectors the driver holds. Edges are numbered and packed once, by rows of W, each a few arrays; of repeated ones the
    greatest weight holds. A round sends the vectors to the packed rows, which return their part of the product."""
    spark = edges.sparkSession
    names = inside.toArrow()["node"].combine_chunks()
    names = names.take(pc.sort_indices(names))
    n, e = len(names), edges.select("a", "b", F.col("w").cast("double").alias("w")).where(F.col("w").isNotNull())
    blocks = max(parts(spark), -(-2 * e.count() // pack))
    known = spark.sparkContext.broadcast(names)

    def numbered(batches: Iterator[pa.RecordBatch], flush: int = 500_000) -> Iterator[pa.RecordBatch]:
        def of(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(got)
            a, c = (pc.index_in(t[x], known.value) for x in "ab")
            ok = pc.and_(pc.is_valid(a), pc.is_valid(c))
            a, c, w = (x.filter(ok).to_numpy() for x in (a, c, t["w"]))
            i, j = np.concatenate([a, c]), np.concatenate([c, a])
            yield from pa.table({"k": (i % blocks).astype(np.int32), "i": i, "j": j, "w": np.tile(w, 2)}).to_batches(10_000)

        got, n = [], 0
        for b in batches:
            got.append(b)
            n += len(b)
            if n >= flush:
                yield from of(got)
                got, n = [], 0
        if got:
            yield from of(got)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        k, i, j, w = t["k"][0].as_py(), *(t[x].to_numpy() for x in "ijw")
        at = (i // blocks).astype(np.int64) * n + j
        order = np.lexsort((w, at))
        at = at[order]
        order = order[np.append(at[1:] != at[:-1], True)]
        count = np.bincount(i[order] // blocks, minlength=len(range(k, n, blocks))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (count, j[order], w[order])]], names=["k", "count", "j", "w"])

    rows = e.mapInArrow(numbered, "k int, i int, j int, w double").repartitionById(blocks, "k")
    rows = cut(rows.mapInArrow(packed, "k int, count binary, j binary, w binary"))
    known.destroy()

    def times(x: np.ndarray) -> np.ndarray:
        """W x."""
        sent = spark.sparkContext.broadcast(np.ascontiguousarray(x.T))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    count, j, w = (np.frombuffer(r[c], kind) for c, kind in (("count", np.int32), ("j", np.int32), ("w", np.float64)))
                    some = count > 0
                    begin = (np.cumsum(count) - count)[some]
                    y = np.zeros((len(sent.value), len(count)))
                    for c, col in enumerate(sent.value):
                        y[c, some] = np.add.reduceat(col[j] * w, begin)
                    yield pa.RecordBatch.from_arrays([pa.array([r["k"]], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["k", "y"])

        y = np.zeros_like(x)
        for r in rows.mapInArrow(product, "k int, y binary").collect():
            y[r["k"] :: blocks] = np.frombuffer(r["y"]).reshape(x.shape[1], -1).T
        sent.destroy()
        return y

    d = times(np.ones((n, 1)))
    root = np.sqrt(d)
    t, c, top = (root / np.sqrt(d.sum()), np.ones_like(d), 1.0) if normalised else (np.full_like(d, n**-0.5), d, d.max())
    image = lambda x: x - times(x / root) / root if normalised else d * x - times(x)
    m = min(block, n - 1)
    x, p = np.linalg.qr(np.random.default_rng(1).standard_normal((n, m)))[0], np.zeros((n, m))
    ax, ap, lam = image(x), np.zeros((n, m)), np.zeros(m)
    none = np.zeros_like(t)
    for k in range(rounds):
        over = ax - x * lam
        if k and lam[0] > 0 and (np.linalg.norm(over[:, :2], axis=0) <= np.maximum(tol * lam[:2], 1e-12 * top)).all():
            ax = image(x)  # its sums of sums are not relied on
            over = ax - x * lam
            if (np.linalg.norm(over[:, :2], axis=0) <= np.maximum(tol * lam[:2], 1e-12 * top)).all():
                xy = x[:, :2] / (root if normalised else 1.0)
                return spark.createDataFrame(pa.table({"node": names, "x": xy[:, 0], "y": xy[:, 1]}))
        w = over / c
        w -= x @ (x.T @ w)
        w /= np.maximum(np.linalg.norm(w, axis=0), 1e-150)
        s, im = np.hstack([x, w, p, t]), np.hstack([ax, image(w), ap, none])
        lam, new, rest = _ritz(s.T @ s, s.T @ im, m)
        x, p, ax, ap = s @ new, s @ rest, im @ new, im @ rest
    raise RuntimeError(f"the eigenvectors did not settle in {rounds} rounds")


def _iterated(e: DataFrame, normalised: bool, rounds: int, tol: float = 1e-5, block: int = 6) -> DataFrame:
    """(node, x, y) by LOBPCG over tables with the constant eigenvector taken out: of I - D^-1/2 W D^-1/2, or of D - W with D as preconditioner.

    Ends when |Lv - lambda v| <= tol * lambda for both vectors, with Lv made anew; raises if that is not reached. A round is one join and one sum;
    products of columns are summed by task and only small matrices come to the driver.
    """
    both = cut(both_ways(e))
    deg = cut(both.groupBy("node").agg(F.sum("w").alias("d")))
    norm, most, n = (lambda r: (r["s"] ** 0.5, r["m"], r["n"]))(deg.agg(F.max("d").alias("m"), F.sum("d").alias("s"), F.count("*").alias("n")).first())
    top = 1.0 if normalised else most
    if normalised:
        of = lambda c: deg.select(F.col("node").alias(c), F.col("d").alias(f"_{c}"))
        both = cut(both.join(of("node"), "node").join(of("other"), "other").select("node", "other", (F.col("w") / F.sqrt(F.col("_node") * F.col("_other"))).alias("w")))
    m = min(block, n - 1)
    start = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2000003)) / 1000001.5 - 1 for k in range(m)]
    none = [F.lit(0.0)] * m
    t = F.sqrt("d") / norm if normalised else F.lit(1 / n**0.5)
    kind = deg.schema["node"].dataType.simpleString()
    schema = f"node {kind}, c double, t double, s array<double>, a array<double>"
    # s: X, W, P; a: AX, AP, with A = diag(c) - K
    state = deg.select("node", (F.lit(1.0) if normalised else F.col("d")).alias("c"), t.alias("t"), F.array(*none, *start, *none).alias("s"), F.array(*none, *none).alias("a"))

    def pulled(state: DataFrame, first: int, many: int) -> DataFrame:
        far = both.join(state.select(F.col("node").alias("other"), "s"), "other")
        sums = far.groupBy("node").agg(*[F.sum(F.col("w") * F.col("s")[first + k]).alias(f"_{k}") for k in range(many)])
        return cut(state.join(sums.select("node", F.array(*[F.col(f"_{k}") for k in range(many)]).alias("q")), "node"))

    def columns(b: pa.RecordBatch, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c, the columns X, W, P, t and what A makes of them; fresh: q is of all columns, else of W."""
        wide = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        c, t, s, q = b.column("c").to_numpy()[:, None], b.column("t").to_numpy()[:, None], wide("s"), wide("q")
        if fresh:
            im = c * s - q
        else:
            im = np.hstack([wide("a")[:, :m], c * s[:, m : 2 * m] - q, wide("a")[:, m:]])
        return c, np.hstack([s, t]), np.hstack([im, np.zeros_like(t)])

    lam = np.zeros(m)
    fresh = False
    for _ in range(rounds):
        full = pulled(state, 0, 3 * m) if fresh else pulled(state, m, m)

        def products(batches: Iterator[pa.RecordBatch], fresh: bool = fresh, lam: np.ndarray = lam) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * (3 * m + 1) + 1, 3 * m + 1))
            for b in batches:
                _, s, im = columns(b, fresh)
                total[: 3 * m + 1] += s.T @ s
                total[3 * m + 1 : -1] += s.T @ im
                total[-1, :m] += ((im[:, :m] - s[:, :m] * lam) ** 2).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        total = sum(np.frombuffer(r["g"]) for r in full.mapInArrow(products, "g binary").collect()).reshape(-1, 3 * m + 1)
        gram, im = total[: 3 * m + 1], total[3 * m + 1 : -1]
        near = (np.sqrt(total[-1, :2]) <= np.maximum(tol * lam[:2], 1e-12 * top)).all() and lam[0] > 0
        if near and fresh:
            x = full.select("node", "c", "t", F.col("s")[0].alias("x"), F.col("s")[1].alias("y"))
            f = 1 / (F.col("t") * norm) if normalised else F.lit(1.0)
            return x.select("node", (F.col("x") * f).alias("x"), (F.col("y") * f).alias("y"))
        lam, new, rest = _ritz(gram, im, m)
        turn = np.hstack([new, rest])

        def turned(batches: Iterator[pa.RecordBatch], fresh: bool = fresh, lam: np.ndarray = lam, turn: np.ndarray = turn) -> Iterator[pa.RecordBatch]:
            listed = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.float64()))
            for b in batches:
                c, s, im = columns(b, fresh)
                s, im = s @ turn, im @ turn
                w = (im[:, :m] - s[:, :m] * lam) / c
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("c"), b.column("t"), listed(np.hstack([s[:, :m], w, s[:, m:]])), listed(im)], names=["node", "c", "t", "s", "a"])

        fresh = bool(near)
        state = full.mapInArrow(turned, schema)
    raise RuntimeError(f"the eigenvectors did not settle in {rounds} rounds")


def in_interval(v: Column, lo: float | Column, hi: float | Column) -> Column:
    """False, not null, for what is not measured."""
    return F.coalesce(v.between(lo, hi), F.lit(False))


def in_wedge(theta: Column, lo: Column | float, hi: Column | float) -> Column:
    """Whether an angle lies between two on the circle; lo > hi goes over zero. Unmeasured angles are outside."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.coalesce(F.when(lo <= hi, theta.between(lo, hi)).otherwise((theta >= lo) | (theta <= hi)), F.lit(False))


def band(df: DataFrame, height: str, theta: str, y: tuple[float, float], t: tuple[float, float]) -> DataFrame:
    return df.where(in_interval(F.col(height), *y) & in_wedge(F.col(theta), *t))


#: Slices of the circle in a cluster's mask.
BUCKETS = 32


def cluster_bands(members: DataFrame, group: str, height: str, theta: str) -> DataFrame:
    """(group, lo, hi, mask): a cluster's height range and the slices of the circle its members lie in."""
    turn = F.pmod(F.col(theta), F.lit(2 * math.pi)) / (2 * math.pi)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.floor(turn * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    return members.groupBy(group).agg(F.min(height).alias("lo"), F.max(height).alias("hi"), F.coalesce(F.bit_or(bit), F.lit(0)).alias("mask"))


def cluster_in_band(bands: DataFrame, y: tuple[float, float], t: tuple[float, float]) -> DataFrame:
    """Clusters of which some member may lie in the band: ranges overlap and a slice of the wedge is taken."""
    size = 2 * math.pi / BUCKETS
    wedge = sum(1 << b for b in range(BUCKETS) if _slice_meets(b * size, (b + 1) * size, *t))
    return bands.where(F.col("lo").isNotNull() & (F.col("lo") <= y[1]) & (F.col("hi") >= y[0]) & (F.col("mask").bitwiseAND(wedge) != 0))


def _slice_meets(a: float, b: float, lo: float, hi: float) -> bool:
    lo, hi = lo % (2 * math.pi), hi % (2 * math.pi)
    parts = [(lo, hi)] if lo <= hi else [(lo, 2 * math.pi), (0.0, hi)]
    return any(a <= q and b >= p for p, q in parts)


def positions(df: DataFrame, theta: str = "theta", r: str = "r", height: str = "height", radius: float = 400.0, tall: float = 600.0) -> DataFrame:
    """x = r cos theta, z = r sin theta, y linear in height with consumers on top; what has no angle sits on the axis."""
    t = F.coalesce(F.col(theta), F.lit(0.0))
    rr = F.when(F.col(theta).isNull(), 0.0).otherwise(F.coalesce(F.col(r), F.lit(0.0))) * radius
    return df.withColumn("x", rr * F.cos(t)).withColumn("z", rr * F.sin(t)).withColumn("y", (F.coalesce(F.col(height), F.lit(0.5)) - 0.5) * tall)


def cluster_coordinates(members: DataFrame, group: str, height: str = "height", theta: str = "theta") -> DataFrame:
    """(group, height, theta, r): mean height of the measured, circular mean of the angles."""
    h = members.groupBy(group).agg(F.avg(height).alias("height"))
    return h.join(circular_mean(members.withColumn("_one", F.lit(1.0)), group, theta, "_one"), group)


def piles(points: DataFrame, node: str = "node", size: str = "stargazers", cell: float = 30.0, least: int = 4) -> DataFrame:
    """(cx, cz, members, hub): cells of the plane in which at least `least` points lie; the hub has most stars, then the smallest name."""
    binned = points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("z") / cell).alias("cz"))
    rank = F.struct((-F.coalesce(F.col(size), F.lit(0))).alias("s"), F.col(node).alias("n"))
    return binned.agg(F.count("*").alias("members"), F.min_by(node, rank).alias("hub")).where(F.col("members") >= least)


def hull_members(points: DataFrame, group: str, node: str = "node", part: float = 0.5, floor: int = 4, radius: float = 130.0) -> DataFrame:
    """(group, node): what a cluster's hull is drawn around: the closest part of its members (at least `floor`), less the farthest ones until
    all lie within radius of their centroid. Distances are ranked in tables; only the kept part, by which the trimming runs, meets in a task."""
    import pandas as pd
    from pyspark.sql import Window

    c = points.groupBy(group).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"), F.avg("z").alias("_cz"), F.count("*").alias("_n"))
    dist = F.sqrt(F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2) + F.pow(F.col("z") - F.col("_cz"), 2))
    near = points.join(c, group).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(dist, node))).where(F.col("_r") <= F.greatest(F.lit(floor), F.ceil(F.col("_n") * part)))

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(node)
        xyz, keep = p[["x", "y", "z"]].to_numpy(), np.ones(len(p), bool)
        while keep.sum() > floor:
            d = np.where(keep, np.linalg.norm(xyz - xyz[keep].mean(0), axis=1), -1)
            if d.max() <= radius:
                break
            keep[int(np.argmax(d))] = False
        return p.loc[keep, [group, node]]

    kind = lambda c: points.schema[c].dataType.simpleString()
    return near.select(group, node, "x", "y", "z").groupBy(group).applyInPandas(trim, f"`{group}` {kind(group)}, `{node}` {kind(node)}")


def projected(p: DataFrame, eye: tuple[float, float, float], yaw: float, pitch: float, focal: float, width: float, tall: float) -> DataFrame:
    """Screen place of points seen from an eye: depth along the view, (sx, sy) in pixels, null behind the eye."""
    x, y, z = (F.col(c) - e for c, e in zip("xyz", eye))
    cx, sx, cy, sy = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch)
    right, away = x * cx - z * sx, x * sx + z * cx
    up, depth = y * cy - away * sy, y * sy + away * cy
    seen = depth > 1e-9
    return p.withColumn("depth", depth).withColumn("sx", F.when(seen, width / 2 + focal * right / depth)).withColumn("sy", F.when(seen, tall / 2 - focal * up / depth))


def picked(screen: DataFrame, at: tuple[float, float], reach: str = "radius") -> DataFrame:
    """The nearest of the points whose disc on the screen holds a place."""
    d = F.hypot(F.col("sx") - at[0], F.col("sy") - at[1])
    return screen.where(F.col("sx").isNotNull() & (d <= F.col(reach))).orderBy("depth", "node").limit(1)
