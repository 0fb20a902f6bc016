"""Components, paths, heights, communities and hierarchies of edge tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, running_sum
from .overlap import both_ways

#: Nodes up to which dense linear algebra on the driver is used (n^2 doubles, 72 MB); larger graphs are solved in tables.
DENSE = 3000


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of each connected component. Labels take their label's and the neighbours' labels' label, and what a
    node finds its label takes too, so whole trees hook onto others and even long chains settle in few rounds."""
    e = cut(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("c"))
    for _ in range(max_rounds):
        above = labels.join(labels.select(F.col("node").alias("c"), F.col("c").alias("g")), "c").select("node", "c", "g")
        near = both.join(above.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("gn"))
        step = above.join(near, "node").select("node", "c", F.least("g", "gn").alias("n"))
        hook = step.groupBy(F.col("c").alias("node")).agg(F.min("n").alias("h"))
        low = F.least("n", F.coalesce("h", "n"))
        new = cut(step.join(hook, "node", "left").select("node", low.alias("c"), (low != F.col("c")).alias("moved")))
        labels = new.select("node", "c")
        if new.where("moved").isEmpty():
            return labels.select("node", F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that hangs together with each of n nodes; u, v: every edge from both ends."""
    least = np.arange(n)
    while True:
        low = least.copy()
        np.minimum.at(low, least[u], least[v])
        while (low[low] != low).any():
            low = low[low]
        low = low[least]
        if (low == least).all():
            return least
        least = low


def stars(edges: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(a, b): fewer edges that connect what edges connects. Each task keeps a row a node, the node and the smallest one of those it hangs together
    with in the task, so edges themselves are neither stored nor shuffled."""

    def merged(rows: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(rows)
        ends = pa.chunked_array([*t["a"].chunks, *t["b"].chunks], t["a"].type)
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(t[x], names).to_numpy().astype(np.int64) for x in "ab")
        return pa.table({"a": names, "b": names.take(pa.array(_least(np.concatenate([a, b]), np.concatenate([b, a]), len(names))))})

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for x in batches:
            rows.append(pa.table({c: x.column(c) for c in "ab"}))  # nulls allowed, as in what merged() makes
            n += len(x)
            if n >= flush:
                rows, n = [merged(rows)], 0
        if rows:
            yield from merged(rows).to_batches(10_000)

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).mapInArrow(kept, f"a {kind}, b {kind}")


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "component")


def largest_nodes(edges: DataFrame) -> DataFrame:
    """(node) of the largest component; of equally large ones that with the smallest node."""
    comp = cut(components(stars(edges)))
    big = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1).select("component")
    return comp.join(big, "component", "left_semi").select("node")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest component; of equally large ones that with the smallest node."""
    return edges.join(largest_nodes(edges).select(F.col("node").alias("a")), "a", "left_semi")


def _centred(x: DataFrame, comp: DataFrame) -> DataFrame:
    mean = x.join(comp, "node").groupBy("component").agg(F.avg("h").alias("_m"))
    return x.join(comp, "node").join(mean, "component").select("node", (F.col("h") - F.col("_m")).alias("h"))


def heights(edges: DataFrame, nodes: DataFrame | None = None, dense: int = DENSE, rounds: int = 400, tol: float = 1e-10) -> DataFrame:
    """(node, raw, height): the least-squares height of directed edges a -> b, each of which wants a one above b.

    L h = out - in with the Laplacian L of all edges, parallel and reciprocal ones added; of all solutions the one of least norm, which has mean 0 in each component;
    turned over if edges point down on average; height is raw scaled to [0, 1] over the graph, 0.5 if it is flat, null for
    nodes without an edge. Up to `dense` nodes numpy solves it on the driver; beyond, conjugate gradients over tables, two joins a round,
    until the residual is tol of the right-hand side; not reaching that in `rounds` is an error.
    """
    e = cut(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))))
    ends = e.select(F.col("a").alias("node"), F.lit(1.0).alias("v")).unionByName(e.select(F.col("b").alias("node"), F.lit(-1.0).alias("v")))
    base = cut(ends.groupBy("node").agg(F.sum("v").alias("v"), F.count("*").cast("double").alias("d")))
    n = base.count()
    spark = edges.sparkSession
    if n == 0:
        raw = base.select("node", F.lit(None).cast("double").alias("h"))
    elif n <= dense:
        names = [r["node"] for r in base.select("node").orderBy("node").collect()]
        at = {x: i for i, x in enumerate(names)}
        lap, v = np.zeros((n, n)), np.zeros(n)
        for r in e.groupBy("a", "b").agg(F.count("*").alias("k")).collect():
            i, j, k = at[r["a"]], at[r["b"]], r["k"]
            lap[i, i] += k
            lap[j, j] += k
            lap[i, j] -= k
            lap[j, i] -= k
            v[i] += k
            v[j] -= k
        h = np.linalg.lstsq(lap, v, rcond=None)[0]
        raw = spark.createDataFrame(list(zip(names, h.tolist())), base.select("node", F.col("v").alias("h")).schema)
    else:
        raw = _conjugate(e, base, rounds, tol)
    raw = cut(raw)
    rise = e.join(raw.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(raw.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b").agg(F.avg(F.col("ha") - F.col("hb")).alias("m"))
    flip = F.when(F.col("m") < 0, -F.col("h")).otherwise(F.col("h"))
    turned = raw.crossJoin(rise).select("node", flip.alias("raw"))
    span = turned.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    out = turned.crossJoin(span).select("node", "raw", F.when(F.col("_hi") - F.col("_lo") < 1e-12, F.lit(0.5)).otherwise((F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("height"))
    return out if nodes is None else nodes.select("node").distinct().join(out, "node", "left")


def _conjugate(e: DataFrame, base: DataFrame, rounds: int, tol: float) -> DataFrame:
    both = cut(e.select(F.col("a").alias("u"), F.col("b").alias("node")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("node"))).groupBy("u", "node").agg(F.count("*").cast("double").alias("k")))
    comp = cut(components(e))
    s = cut(base.select("node", "d", F.lit(0.0).alias("h"), F.col("v").alias("r"), F.col("v").alias("p")))
    rr = s.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    small = tol * tol * rr
    for _ in range(rounds):
        if rr <= small:
            break
        pull = both.join(s.select("node", F.col("p").alias("pn")), "node").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("k") * F.col("pn")).alias("q"))
        t = cut(s.join(pull, "node").withColumn("ap", F.col("d") * F.col("p") - F.col("q")))
        alpha = rr / t.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        t = t.withColumn("h", F.col("h") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap"))
        new = t.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        s = cut(t.select("node", "d", "h", "r", (F.col("r") + (new / rr) * F.col("p")).alias("p")))
        rr = new
    if rr > small:
        raise RuntimeError(f"heights did not settle in {rounds} rounds")
    return _centred(s.select("node", "h"), comp)


def incoherence(edges: DataFrame, h: DataFrame, raw: str = "raw") -> DataFrame:
    """(mean_delta, incoherence): of a's raw height over b's, the mean, and the root mean square of what it lacks to 1."""
    d = edges.join(h.select(F.col("node").alias("a"), F.col(raw).alias("ha")), "a").join(h.select(F.col("node").alias("b"), F.col(raw).alias("hb")), "b").select((F.col("ha") - F.col("hb")).alias("d"))
    return d.agg(F.avg("d").alias("mean_delta"), F.sqrt(F.avg((F.col("d") - 1) * (F.col("d") - 1))).alias("incoherence"))


def scale(h: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw_min, raw_max, level_step_normalized): one edge's step on the [0, 1] scale."""
    return h.agg(F.min(raw).alias("raw_min"), F.max(raw).alias("raw_max"), (1 / (F.max(raw) - F.min(raw))).alias("level_step_normalized"))


def height_of_new(deps: DataFrame, h: DataFrame, step: DataFrame) -> DataFrame:
    """(node, height): the mean height of a new node's dependencies, one level up."""
    return deps.join(h.select(F.col("node").alias("dep"), "height"), "dep").groupBy("node").agg(F.avg("height").alias("_m")).crossJoin(step).select("node", (F.col("_m") + F.col("level_step_normalized")).alias("height"))


#: Edges up to which communities are moved by one task, by the same rule and to the same result as in tables (some 370 bytes of its memory an edge).
LOCAL_EDGES = 500_000


#: A checksum's own bits flip together for all nodes from round to round; its rest by a prime does not.
_PRIME = 1000003


def _moved_here(rows: pa.Table, resolution: float, rounds: int, seed: int) -> pa.Table:
    """communities() for edges (a, b, w) in memory; nodes are numbered in their order."""
    ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks], rows["a"].type)
    names = pc.unique(ends)
    names = names.take(pc.sort_indices(names))
    n = len(names)
    a, b = (pc.index_in(rows[x], names).to_numpy().astype(np.int64) for x in "ab")
    u, v, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(pc.fill_null(rows["w"], 0.0).to_numpy(), 2)
    k = np.bincount(u, w, n)
    two_m, every = k.sum(), np.arange(n)
    begun = [zlib.crc32(str(x).encode()) for x in names.to_pylist()]
    c = every.copy()
    for r in range(rounds if two_m else 0):
        tot = np.bincount(c, k, n)
        keys, place = np.unique(np.concatenate([u * n + c[v], every * n + c]), return_inverse=True)
        wc = np.bincount(place, np.concatenate([w, np.zeros(n)]))
        node, cn = keys // n, keys % n
        own = cn == c[node]
        gain = np.round(wc - resolution * k[node] * (tot[cn] - np.where(own, k[node], 0.0)) / two_m, 9)
        best = np.lexsort((cn, own, gain, node))
        to = cn[best[np.flatnonzero(np.append(node[best][1:] != node[best][:-1], True))]]
        moved = np.flatnonzero(to != c)
        if not len(moved):
            break
        said = f"|{r}|{seed}".encode()
        awake = moved[[zlib.crc32(said, begun[x]) % _PRIME % 2 == 0 for x in moved.tolist()]]
        c[awake] = to[awake]
    inside = c[u] == c[v]
    return pa.table({"node": names, "community": names.take(pa.array(_least(u[inside], v[inside], n)))})


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, seed: int = 1, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, community): a partition into connected communities by local moves of modularity with a resolution.

    Each round every other node, by a hash of node, round and seed, moves to the neighbouring community of greatest gain; communities that fall apart are split into
    their components, and a community is named by its smallest node. Deterministic for a seed.
    """
    e = cut(edges.select("a", "b", F.col("w").cast("double").alias("w")).where(F.col("a") != F.col("b")))
    if e.count() <= local_edges:

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := [b for b in batches if len(b)]:
                yield from _moved_here(pa.Table.from_batches(got), resolution, rounds, seed).to_batches(10_000)

        kind = e.schema["a"].dataType.simpleString()
        return cut(e.coalesce(1).mapInArrow(moved, f"node {kind}, community {kind}"))
    both = cut(both_ways(e).groupBy("node", "other").agg(F.sum("w").alias("w")))
    deg = cut(both.groupBy("node").agg(F.sum("w").alias("k")))
    two_m = deg.agg(F.sum("k")).first()[0]
    cur = cut(deg.select("node", "k", F.col("node").alias("c")))
    for r in range(rounds if two_m else 0):
        tot = cur.groupBy("c").agg(F.sum("k").alias("tot"))
        links = both.join(cur.select(F.col("node").alias("other"), F.col("c").alias("cn")), "other").groupBy("node", "cn").agg(F.sum("w").alias("wc"))
        own = cur.select("node", F.col("c").alias("cn"), F.lit(0.0).alias("wc"))
        cand = links.unionByName(own).groupBy("node", "cn").agg(F.sum("wc").alias("wc")).join(cur, "node").join(tot.withColumnRenamed("c", "cn"), "cn")
        there = F.col("tot") - F.when(F.col("cn") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("wc") - resolution * F.col("k") * there / two_m, 9)
        best = cand.groupBy("node").agg(F.max_by("cn", F.struct(gain.alias("g"), (F.col("cn") == F.col("c")).alias("s"), F.col("cn").alias("n"))).alias("to"))
        awake = F.crc32(F.concat(F.col("node").cast("string"), F.lit(f"|{r}|{seed}"))) % _PRIME % 2 == 0
        new = cut(cur.join(best, "node").select("node", "k", F.when(awake, F.col("to")).otherwise(F.col("c")).alias("c"), (F.col("to") != F.col("c")).alias("moved")))
        cur = new.select("node", "k", "c")
        if new.where("moved").isEmpty():
            break
    c = cur.select("node", "c")
    inside = e.join(c.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a").join(c.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b").where(F.col("ca") == F.col("cb"))
    comp = components(inside.select("a", "b"))
    return c.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


def level_edges(edges: DataFrame, member: DataFrame, node: str = "node", cluster: str = "community") -> DataFrame:
    """(a, b, w): summed weights of the edges that cross between clusters."""
    m = member.select(F.col(node).alias("_n"), F.col(cluster).alias("_c"))
    x = edges.join(m.select(F.col("_n").alias("a"), F.col("_c").alias("ca")), "a").join(m.select(F.col("_n").alias("b"), F.col("_c").alias("cb")), "b").where(F.col("ca") != F.col("cb"))
    return x.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def rollup(member: DataFrame, stats: DataFrame, cluster: str = "community") -> DataFrame:
    """(cluster, member_count, stargazers, forks, degree, hub): sums over members, missing counts as 0 here only; the hub is the member of greatest degree, then smallest name.

    stats: node, stargazers, forks, degree, members (1 for a repository).
    """
    j = member.join(stats, "node", "left")
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return j.groupBy(F.col(cluster).alias("cluster")).agg(
        F.sum(F.coalesce("members", F.lit(1))).cast("long").alias("member_count"),
        z("stargazers"),
        z("forks"),
        F.sum(F.coalesce("degree", F.lit(0.0))).alias("degree"),
        F.min_by("node", F.struct((-F.coalesce("degree", F.lit(0.0))).alias("d"), F.col("node").alias("n"))).alias("hub"),
    )


def hierarchy(edges: DataFrame, nodes: DataFrame, resolutions: tuple[float, ...] = (2.0, 3.0), most: int = 40, levels: int = 8, k: int = 20) -> DataFrame:
    """(level, cluster, child): communities of communities until at most `most` have more than one repository, nothing merges, or `levels` is reached.

    Edges are thinned to mutual k strongest first. Nodes without an edge are communities of their own. Clusters are named cluster/<level>/<smallest repository>.
    """
    from .overlap import prune_mutual

    cur_edges = cut(prune_mutual(edges, k))
    cur = cut(nodes.select("node").distinct().select("node", F.lit(1).cast("long").alias("members"), F.col("node").alias("first")))
    out = None
    for level in range(levels):
        part = communities(cur_edges, resolutions[min(level, len(resolutions) - 1)])
        member = cut(cur.join(part, "node", "left").select("node", "members", "first", F.coalesce("community", "node").alias("_c")))
        named = cut(member.groupBy("_c").agg(F.min("first").alias("first"), F.sum("members").alias("members"), F.count("*").alias("n")).withColumn("id", F.concat(F.lit(f"cluster/{level}/"), "first")))
        rows = member.join(named.select("_c", "id"), "_c").select(F.lit(level).alias("level"), F.col("id").alias("cluster"), F.col("node").alias("child"))
        out = rows if out is None else out.unionByName(rows)
        state = named.agg(F.sum((F.col("members") > 1).cast("int")).alias("real"), F.max("n").alias("widest")).first()
        link = member.join(named.select("_c", "id"), "_c").select("node", "id")
        cur_edges = cut(level_edges(cur_edges, link, "node", "id"))
        cur = cut(named.select(F.col("id").alias("node"), "members", "first"))
        if (state["real"] or 0) <= most or state["widest"] == 1:
            break
    return cut(out)


def flat_members(tree: DataFrame, rounds: int = 16) -> DataFrame:
    """(cluster, member): every cluster's leaves, by walking down one level per round."""
    clusters = tree.select("cluster").distinct()
    open_ = tree.select("cluster", F.col("child").alias("at"))
    out = None
    for _ in range(rounds):
        leaf = open_.join(clusters.select(F.col("cluster").alias("at")), "at", "left_anti").select("cluster", F.col("at").alias("member"))
        out = leaf if out is None else out.unionByName(leaf)
        open_ = cut(open_.join(tree.select(F.col("cluster").alias("at"), F.col("child").alias("next")), "at").select("cluster", F.col("next").alias("at")))
        if open_.isEmpty():
            return out.distinct()
    raise RuntimeError("the tree is deeper than the rounds")


def without_singletons(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree without clusters of one leaf, top): references to such a cluster become its leaf; top (id, member_count) is what no cluster holds,
    largest first, then by id."""
    flat = cut(flat_members(tree))
    size = cut(flat.groupBy("cluster").agg(F.count("*").alias("n"), F.min("member").alias("leaf")))
    sole = size.where(F.col("n") == 1).select(F.col("cluster").alias("child"), "leaf")
    kept = tree.join(size.where(F.col("n") > 1).select("cluster"), "cluster", "left_semi").join(sole, "child", "left").select("level", "cluster", F.coalesce("leaf", "child").alias("child"))
    roots = size.join(tree.select(F.col("child").alias("cluster")).distinct(), "cluster", "left_anti")
    top = roots.select(F.when(F.col("n") == 1, F.col("leaf")).otherwise(F.col("cluster")).alias("id"), F.col("n").alias("member_count")).distinct().orderBy(F.col("member_count").desc(), "id")
    return kept, top


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns of least total cost, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in _assign(cost.T)]
    row_pot, col_pot, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        base = 0.0
        while True:
            reach = base + cost[row] - row_pot[row] - col_pot
            better = ~done & (reach < dist - 1e-15)
            dist[better], back[better] = reach[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
        end = base
        seen = np.flatnonzero(done & (dist <= end))
        row_pot[start] += end
        for c in seen.tolist():
            if owner[c] >= 0:
                row_pot[owner[c]] += end - dist[c]
            col_pot[c] -= end - dist[c]
        while col >= 0:
            prev = int(back[col])
            owner[col] = owner[prev] if prev >= 0 else start
            col = prev
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]


def stable_ids(new: DataFrame, old: DataFrame, least: float = 0.5, most: int = 4000) -> DataFrame:
    """(level, cluster, stable_id, matched): per level, the assignment of new to old clusters of greatest total Jaccard; pairs of at
    least `least` keep the old id, the others get ids after the highest number in use.

    new, old: (level, cluster, member). Clusters without a common member are never matched, so the assignment is split by the connected components of
    the overlaps, a task each; a component of more than `most` new or old clusters raises, as its assignment is dense.
    """
    n, o = new.select("level", F.col("cluster").alias("x"), "member").distinct(), old.select("level", F.col("cluster").alias("y"), "member").distinct()
    nx, ny = n.groupBy("level", "x").agg(F.count("*").alias("nx")), o.groupBy("level", "y").agg(F.count("*").alias("ny"))
    both = n.join(o, ["level", "member"]).groupBy("level", "x", "y").agg(F.count("*").alias("c")).join(nx, ["level", "x"]).join(ny, ["level", "y"])
    both = cut(both.select("level", "x", "y", (F.col("c") / (F.col("nx") + F.col("ny") - F.col("c"))).alias("j"), F.concat_ws("|", F.lit("n"), "level", "x").alias("a"), F.concat_ws("|", F.lit("o"), "level", "y").alias("b")))
    comp = components(both).select(F.col("node").alias("a"), "component")

    def match(part):
        a, b = sorted(set(part["x"])), sorted(set(part["y"]))
        if max(len(a), len(b)) > most:
            raise ValueError(f"level {part['level'].iloc[0]} has more than {most} clusters that hang together")
        score = np.zeros((len(a), len(b)))
        ia, ib = {x: i for i, x in enumerate(a)}, {y: i for i, y in enumerate(b)}
        for x, y, j in zip(part["x"], part["y"], part["j"]):
            score[ia[x], ib[y]] = j
        got = [(a[i], b[j]) for i, j in _assign(1 - score) if score[i, j] >= least]
        return type(part)({"level": [part["level"].iloc[0]] * len(got), "x": [x for x, _ in got], "y": [y for _, y in got]}, dtype=object)

    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("level", "x", "y"))
    kept = both.join(comp, "a").groupBy("level", "component").applyInPandas(match, kinds)
    every = cut(nx.select("level", "x").join(kept, ["level", "x"], "left"))
    number = F.regexp_extract(F.col("c"), r"(?:^|/)(\d+)$", 1).try_cast("long")
    last = nx.select(F.col("x").alias("c")).unionByName(ny.select(F.col("y").alias("c"))).agg(F.coalesce(F.max(number), F.lit(-1))).first()[0]
    fresh = running_sum(every.where(F.col("y").isNull()).withColumn("_one", F.lit(1)), [], [F.col("level"), F.col("x")], "_one", "_k")
    fresh = fresh.select("level", F.col("x").alias("cluster"), F.concat(F.lit("cluster/"), F.col("level").cast("string"), F.lit("/"), (F.col("_k") + last).cast("string")).alias("stable_id"), F.lit(False).alias("matched"))
    return every.where(F.col("y").isNotNull()).select("level", F.col("x").alias("cluster"), F.col("y").alias("stable_id"), F.lit(True).alias("matched")).unionByName(fresh)


def shortest_path(tiers: DataFrame, start: str, goal: str, max_hops: int | None = None) -> DataFrame:
    """(hop, node, tier): one shortest path over all tiers as one undirected graph; of several, by tier order, then smallest node at each step back.

    tiers: (a, b, tier, rank). Frontier after frontier is joined with the edges until none is left; visited nodes never return. A bound of hops that is reached raises.
    """
    both = cut(tiers.select(F.col("a").alias("u"), F.col("b").alias("v"), "tier", "rank").unionByName(tiers.select(F.col("b").alias("u"), F.col("a").alias("v"), "tier", "rank")).where(F.col("u") != F.col("v")).distinct())
    spark = tiers.sparkSession
    seen = spark.createDataFrame([(start, 0, None, None)], "node string, hop int, prev string, tier string")
    front = seen
    hop = 0
    while start != goal:
        if hop == max_hops:
            raise RuntimeError(f"no path within {max_hops} hops, but there are nodes beyond")
        hop += 1
        step = both.join(front.select(F.col("node").alias("u")), "u").join(seen.select(F.col("node").alias("v")), "v", "left_anti")
        front = cut(step.groupBy("v").agg(F.min_by(F.struct("u", "tier"), F.struct("rank", "u")).alias("p")).select(F.col("v").alias("node"), F.lit(hop).alias("hop"), F.col("p.u").alias("prev"), F.col("p.tier").alias("tier")))
        if front.isEmpty():
            return spark.createDataFrame([], "hop int, node string, tier string")
        seen = cut(seen.unionByName(front))
        if not front.where(F.col("node") == goal).isEmpty():
            break
    at, path = goal, []
    while at is not None:  # one row a hop
        r = seen.where(F.col("node") == at).first()
        path.append((r["hop"], r["node"], r["tier"]))
        at = r["prev"]
    return spark.createDataFrame(sorted(path), "hop int, node string, tier string")


def path_between(near: Callable[[DataFrame], DataFrame], one: Callable[[str], DataFrame], start: str, goal: str) -> list[tuple[int, str, str | None]]:
    """(hop, node, tier): the path of shortest_path() where edges are not kept: near(nodes) makes the edges (u, v, tier, rank) of a table of nodes u, in either direction.

    Levels grow from both ends, the smaller one next, until two meet, so only nodes near the ends have their edges made; then those levels of the goal's side are
    narrowed to nodes on shortest paths, and a walk goes back from the goal. Empty if there is no path.
    """
    if start == goal:
        return [(0, start, None)]
    levels, sizes = [[one(start)], [one(goal)]], [1, 1]
    seen = [one(start), one(goal)]
    met = None
    while met is None or met.isEmpty():
        s = int(sizes[1] < sizes[0])
        new = cut(near(levels[s][-1]).select(F.col("v").alias("node")).distinct().join(seen[s], "node", "left_anti"))
        sizes[s] = new.count()
        if not sizes[s]:
            return []
        levels[s].append(new)
        seen[s] = cut(seen[s].unionByName(new))
        met = new.join(levels[1 - s][-1], "node", "left_semi")
    there, back = levels
    good = [cut(met)] if len(back) > 1 else []
    for level in back[-2:0:-1]:
        good.append(cut(level.join(near(good[-1]).select(F.col("v").alias("node")), "node", "left_semi")))
    at, path = goal, []
    layers = [*good[::-1], *there[-2::-1]]
    for hop, layer in zip(range(len(layers), 0, -1), layers):
        r = near(one(at)).join(layer.select(F.col("node").alias("v")), "v", "left_semi").agg(F.min_by(F.struct("v", "tier"), F.struct("rank", "v")).alias("p")).first()["p"]
        path.append((hop, at, r["tier"]))
        at = r["v"]
    return [(0, at, None), *path[::-1]]


def within_hops(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, hop): everything within so many hops, with its distance."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    kind = edges.schema["a"].dataType.simpleString()
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        front = cut(both.join(front.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def ancestors(tree: DataFrame, rounds: int = 16) -> DataFrame:
    """(node, path): from each child up to its root, the node first, a synthetic root last."""
    up = tree.select(F.col("child").alias("_c"), F.col("cluster").alias("_p")).distinct()
    cur = tree.select(F.col("child").alias("node")).distinct().select("node", F.array("node").alias("path"), F.col("node").alias("at"))
    for _ in range(rounds):
        cur = cut(cur.join(up, F.col("at") == F.col("_c"), "left").select("node", F.when(F.col("_p").isNotNull(), F.concat("path", F.array("_p"))).otherwise(F.col("path")).alias("path"), F.col("_p").alias("at")))
        if cur.where(F.col("at").isNotNull()).isEmpty():
            break
    return cur.select("node", F.concat("path", F.array(F.lit("root"))).alias("path"))


def tree_paths(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, lca, path): the way from a to b over their lowest common cluster."""
    x = pairs.join(paths.select(F.col("node").alias("a"), F.col("path").alias("pa")), "a").join(paths.select(F.col("node").alias("b"), F.col("path").alias("pb")), "b")
    x = x.withColumn("lca", F.get(F.filter("pa", lambda c: F.array_contains("pb", c)), F.lit(0)))
    up = F.slice("pa", 1, F.array_position("pa", F.col("lca")).cast("int"))
    down = F.reverse(F.slice("pb", 1, (F.array_position("pb", F.col("lca")) - 1).cast("int")))
    return x.select("a", "b", "lca", F.concat(up, down).alias("path"))
