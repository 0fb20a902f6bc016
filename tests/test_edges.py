import hashlib
import itertools
import random

import pytest

from ravelin.operators import association, graph, identity, layout, overlap, resolve


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def abc(spark):
    pairs = [(k, i) for k, items in {"A": "1234", "B": "123", "C": "1239"}.items() for i in items]
    return spark.createDataFrame(pairs + [(None, "1"), ("A", None), ("A", "1")], "left string, item string")


def test_overlap_and_prunes(abc):
    e = overlap.overlap_edges(abc, min_shared=3, with_members=True)
    assert rows(e, "a", "b", "w") == [("A", "B", 3), ("A", "C", 3), ("B", "C", 3)]
    assert {tuple(r.members) for r in e.collect()} == {("1", "2", "3")}
    assert rows(overlap.prune_either(e, 1), "a", "b") == [("A", "C"), ("B", "C")]
    assert rows(overlap.prune_mutual(e, 1), "a", "b") == [("B", "C")]


@pytest.mark.parametrize("hot", [1, 3, 1000])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_overlap_is_exact_with_hot_items(spark, hot, k):
    rnd = random.Random(5)
    sets = {f"n{i:02d}": {f"i{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(0, 9))} for i in range(30)}
    df = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s], "left string, item string")
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= k)
    got = overlap.overlap_edges(df, min_shared=k, with_members=True, hot=hot)
    assert rows(got, "a", "b", "w") == want
    assert all(r.members == sorted(sets[r.a] & sets[r.b]) for r in got.collect())


def test_max_weight_merge(spark):
    al = spark.createDataFrame([("x", "y")], "alias string, canon string")
    e = spark.createDataFrame([("x", "b", 3, ["p"]), ("y", "b", 5, ["q"]), ("x", "y", 9, ["r"])], "a string, b string, w long, members array<string>")
    assert [tuple(r) for r in resolve.merged_edges(e, al).collect()] == [("y", "b", 5, ["p", "q"])]


def test_min_max_of_equal_weights(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0)], "a string, b string, w double")
    assert rows(association.min_max(e), "w") == [(1.0,), (1.0,)]


def test_pmi(spark):
    docs = spark.createDataFrame([(d, i) for d, s in {"d1": "ab", "d2": "ab", "d3": "ab", "d4": "c"}.items() for i in s], "doc string, item string")
    (r,) = association.positive_pmi(docs, min_item=3, min_pair=3).collect()
    assert (r.a, r.b, round(r.w, 6)) == ("a", "b", 0.287682)


def test_containment_rule(spark):
    refs = spark.createDataFrame([("x", i) for i in range(10)] + [("y", i) for i in range(1, 100)] + [("p", 500)] + [("q", i) for i in range(500, 600)], "origin string, object_id long")
    c = spark.createDataFrame([("x", "y"), ("p", "q")], "a string, b string")
    got = overlap.containment(c, refs)
    assert rows(got, "a", "b", "shared", "containment") == [("p", "q", 1, 1.0), ("x", "y", 9, 0.9)]
    assert rows(overlap.same_by_containment(got), "a", "b") == [("x", "y")]


def test_lookup_prefers_canonical(spark):
    nodes = spark.createDataFrame([("Org/New",)], "node string")
    al = spark.createDataFrame([("old/x", "org/new"), ("z/z", "not/there")], "alias string, canon string")
    assert rows(resolve.lookup(nodes, al), "key", "node") == [("old/x", "Org/New"), ("org/new", "Org/New")]


def test_heights(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    n = spark.createDataFrame([("a",), ("d",)], "node string")
    h = {r.node: (r.raw, r.height) for r in graph.heights(e).collect()}
    assert [round(h[x][0], 6) for x in "abc"] == [1, 0, -1] and [round(h[x][1], 6) for x in "abc"] == [1, 0.5, 0]
    assert rows(graph.heights(e, n).where("height is null"), "node") == [("d",)]
    assert graph.incoherence(e, graph.heights(e)).first().incoherence == pytest.approx(0, abs=1e-9)
    two = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    assert {r.node: round(r.height, 6) for r in graph.heights(two).collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    assert {round(r.height, 6) for r in graph.heights(ring).collect()} == {0.5}


def test_heights_in_tables_equal_dense_ones(spark):
    rnd = random.Random(3)
    e = spark.createDataFrame([(f"n{rnd.randint(0, 12)}", f"n{rnd.randint(0, 12)}") for _ in range(25)] + [("x", "y")], "a string, b string")
    dense = {r.node: r.raw for r in graph.heights(e).collect()}
    tables = {r.node: r.raw for r in graph.heights(e, dense=0).collect()}
    assert dense.keys() == tables.keys() and all(abs(dense[k] - tables[k]) < 1e-6 for k in dense)


def test_communities_are_the_same_in_tables(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)], "a string, b string, w double")
    here = rows(graph.communities(e), "node", "community")
    assert here == rows(graph.communities(e, local_edges=0), "node", "community")
    assert {c for _, c in here} == {"a", "d"}


def test_singletons_collapse(spark):
    tree = spark.createDataFrame([(0, "c0", "r"), (1, "c1", "c0"), (0, "k0", "x"), (0, "k0", "y")], "level int, cluster string, child string")
    kept, top = graph.without_singletons(tree)
    assert [tuple(t) for t in top.collect()] == [("k0", 2), ("r", 1)]
    assert rows(kept, "cluster", "child") == [("k0", "x"), ("k0", "y")]


def test_assignment_runs_before_the_threshold(spark):
    n1, o2, n2 = [f"s{i}" for i in range(7)], ["t0", "t1", "t2"], ["u0", "u1", "u2"]
    new = [(0, "cluster/0/0", m) for m in n1 + o2] + [(0, "cluster/0/1", m) for m in n2]
    old = [(0, "cluster/0/5", m) for m in n1 + n2] + [(0, "cluster/0/6", m) for m in o2]
    s = "level int, cluster string, member string"
    got = graph.stable_ids(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).collect()
    assert not any(r.matched for r in got) and {r.stable_id for r in got} == {"cluster/0/7", "cluster/0/8"}
    same = graph.stable_ids(spark.createDataFrame(new, s), spark.createDataFrame([(lv, c.replace("/0/", "/0/9"), m) for lv, c, m in new], s)).collect()
    assert all(r.matched for r in same)


def test_assignment_is_optimal():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5)]:
        c = rnd.random((n, m)).round(2)
        got = graph._assign(c)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        small, big = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum((c[i, j] if n <= m else c[j, i]) for i, j in zip(small, p)) for p in itertools.permutations(big, len(small)))
        assert sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_paths(spark):
    t = spark.createDataFrame([("a", "b", "x", 0), ("b", "c", "y", 1), ("a", "d", "x", 0), ("d", "e", "x", 0), ("e", "c", "x", 0)], "a string, b string, tier string, rank int")
    assert [(r.hop, r.node, r.tier) for r in graph.shortest_path(t, "a", "c").collect()] == [(0, "a", None), (1, "b", "x"), (2, "c", "y")]
    assert graph.shortest_path(t, "a", "zzz").count() == 0
    assert rows(graph.within_hops(t, "a", 1), "node", "hop") == [("a", 0), ("b", 1), ("d", 1)]


def test_tree_paths(spark):
    tree = spark.createDataFrame([(0, "p", "a"), (0, "p", "b"), (0, "q", "c")], "level int, cluster string, child string")
    got = graph.tree_paths(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), graph.ancestors(tree))
    assert {(r.b, r.lca, tuple(r.path)) for r in got.collect()} == {("b", "p", ("a", "p", "b")), ("c", "root", ("a", "p", "root", "q", "c"))}


def test_circular_mean_and_wedge(spark):
    import math

    df = spark.createDataFrame([("r", 0.0, 1.0), ("r", math.pi / 2, 1.0), ("z", 1.0, 0.0), ("n", None, 1.0)], "k string, t double, w double")
    got = {r.k: (r.theta, r.r) for r in layout.circular_mean(df, "k", "t", "w").collect()}
    assert got["r"] == pytest.approx((math.pi / 4, 0.707107), abs=1e-6) and got["z"] == (None, 0.0) and got["n"] == (None, 0.0)
    from pyspark.sql import functions as F

    th = spark.createDataFrame([(10.0,), (200.0,), (None,)], "t double")
    assert [r.x for r in th.select(layout.in_wedge(F.col("t"), 300, 60).alias("x")).collect()] == [True, False, False]


def test_spectral_uses_the_largest_component(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("x", "y", 1.0)], "a string, b string, w double")
    assert {r.node for r in layout.spectral(e).collect()} == set("abcd")
    assert layout.spectral(spark.createDataFrame([("x", "y", 1.0)], e.schema)).count() == 0


@pytest.mark.parametrize("normalised", [True, False])
def test_spectral_in_tables_equals_dense(spark, normalised):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}", 1.0 + 0.4 * (i == 3)) for i in range(12)] + [("n00", "n02", 2.0), ("n05", "n08", 0.3)]
    e = spark.createDataFrame(ring, "a string, b string, w double")
    dense = {r.node: (r.theta, r.r) for r in layout.spectral(e, normalised).collect()}
    tables = {r.node: (r.theta, r.r) for r in layout.spectral(e, normalised, dense=2, rounds=250).collect()}
    import math

    assert all(abs(math.remainder(dense[k][0] - tables[k][0], 2 * math.pi)) < 0.1 and abs(dense[k][1] - tables[k][1]) < 0.1 for k in dense)


@pytest.mark.parametrize("normalised", [True, False])
def test_spectral_in_tables_settles(spark, normalised):
    import math
    import random

    rnd = random.Random(3)
    pairs = {(i, (i + j) % 300) for i in range(300) for j in (1, 2) if i % 300 < (i + j) % 300}  # a long path
    pairs |= {(300, i) for i in range(0, 120)} | {tuple(sorted(rnd.sample(range(200, 300), 2))) for _ in range(200)}  # a hub and a lump
    e = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", 1.0 + rnd.random()) for a, b in sorted(pairs)], "a string, b string, w double")
    dense = {r.node: (r.theta, r.r) for r in layout.spectral(e, normalised).collect()}
    tables = {r.node: (r.theta, r.r) for r in layout.spectral(e, normalised, dense=2).collect()}
    assert dense.keys() == tables.keys()
    assert all(abs(r * math.remainder(t - tables[k][0], 2 * math.pi)) < 1e-3 and abs(r - tables[k][1]) < 1e-3 for k, (t, r) in dense.items())
    with pytest.raises(RuntimeError):
        layout.spectral(e, normalised, dense=2, rounds=3)


def test_shortest_path_of_many_hops(spark):
    line = [(f"n{i:02d}", f"n{i + 1:02d}", "t", 0) for i in range(15)] + [("x", "y", "t", 0)]
    e = spark.createDataFrame(line, "a string, b string, tier string, rank int")
    assert [r.node for r in graph.shortest_path(e, "n00", "n15").orderBy("hop").collect()] == [f"n{i:02d}" for i in range(16)]
    assert graph.shortest_path(e, "n00", "y").count() == 0
    with pytest.raises(RuntimeError):
        graph.shortest_path(e, "n00", "n15", max_hops=4)


def test_unsettled_heights_raise(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("n00", "n09")], "a string, b string")
    with pytest.raises(RuntimeError):
        graph.heights(e, dense=2, rounds=3)


def test_quota_and_priority(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "py" if i < 8 else "go") for i in range(12)], "i int, l string")
    assert rows(resolve.quota(df, F.col("l"), [F.col("i")], 4), "i") == [(0,), (1,), (8,), (9,)]


def test_upper_median(spark):
    assert resolve.upper_median(spark.createDataFrame([(x,) for x in (4, 2, 3, 1, None)], "v int"), "v").first().median == 3


def test_cosine_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "k int, v array<double>")
    assert rows(overlap.cosine_edges(v, "k", "v", 0.7, block=2), "a", "b") == [(1, 2)]


def test_signatures_tell_sets_apart(spark):
    from ravelin.operators import labels

    m = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("b", "x"), ("b", None), ("c", "x"), ("d", "xy")], "cluster string, member string")
    got = {r.cluster: r.signature for r in labels.signatures(m, "cluster", "member").collect()}
    assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"]}) == 3


def test_only_the_compared_pair_meets(spark, small, monkeypatch):
    from ravelin.plans import maps
    from ravelin.runtime import table

    met = []
    whole = overlap.overlap_edges
    monkeypatch.setattr(overlap, "overlap_edges", lambda p, *a, **k: met.append(p.select("left").distinct().count()) or whole(p, *a, **k))
    got = dict(map(tuple, maps.g18_compared(spark, small).collect()))
    assert set(got) == {"stargazer", "semantic"} and got["stargazer"] > 0
    assert met and max(met) <= 2 < table(spark, small, "topics").count()


@pytest.mark.parametrize("short", [0, 1000])
@pytest.mark.parametrize("k", [1, 3])
def test_overlap_is_exact_for_lists_of_any_length(spark, short, k):
    rnd = random.Random(7)
    sets = {f"n{i:02d}": {f"i{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(0, 9))} for i in range(30)}
    df = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s], "left string, item string")
    want = sorted((a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= k)
    assert rows(overlap.overlap_edges(df, min_shared=k, hot=3, short=short), "a", "b", "w") == want


def test_pairs_of_short_lists_are_not_shuffled(abc):
    e = overlap.overlap_edges(abc, min_shared=3, with_members=True)
    assert "hashpartitioning(a#" not in e._jdf.queryExecution().executedPlan().toString()


def test_mirror_beyond_the_smallest_ids_is_found(spark):
    """No id of the pair is among the larger one's 96 smallest, and all common ids have more than 40 holders."""
    mirror = [f"x{i:02}" for i in range(20)]
    sets = {"a/mirror": mirror, "b/whole": mirror + [f"a{i:03}" for i in range(150)], "c/one": ["x00", *(f"c{i}" for i in range(9))]}
    sets |= {f"z/{k:02}": [*mirror, *(f"z{k:02}{j}" for j in range(60))] for k in range(45)}
    refs = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "origin string, object_id string")
    pages = spark.createDataFrame([(k, k, False, None) for k in sets], "repo string, full_name string, fork boolean, parent_full_name string")
    got = dict(rows(identity.groups(pages, identity.evidence(pages, refs)), "repo", "group"))
    assert got == {k: "c/one" if k == "c/one" else "a/mirror" for k in sets}


def _connected(pairs):
    group = {}
    for a, b in pairs:
        both = group.get(a, {a}) | group.get(b, {b})
        group |= dict.fromkeys(both, both)
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("heavy", [0, 30, 10**9])
def test_shared_refs_connect_as_all_pairs_do(spark, heavy):
    rnd = random.Random(9)
    base = [f"b{i:02}" for i in range(30)]
    sets = {f"n{i:02}": set(base) - {base[i % 30]} | {f"own{i}"} for i in range(40)}
    sets |= {f"m{i:02}": set(rnd.sample(base, rnd.randint(1, 6))) | set(rnd.sample("pqrstuvw", rnd.randint(0, 3))) for i in range(60)}
    sets |= {f"s{i:02}": {*rnd.sample("pqrstuvw", 5), *(f"t{i // 8}{j}" for j in range(rnd.randint(0, 9)))} for i in range(60)} | {"two": {"b00", "p"}, "one": {"p"}, "copy": {"b00", "p"}}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= 2 and n / min(len(sets[a]), len(sets[b])) >= 0.9}
    data = [(k, hashlib.sha1(i.encode()).digest()) for k, v in sets.items() for i in v] + [(None, b"x"), ("n00", None), ("one", hashlib.sha1(b"p").digest())]
    got = {(r.a, r.b) for r in identity.same_refs(spark.createDataFrame(data, "origin string, object_id binary"), heavy=heavy).collect()}
    assert {(min(p), max(p)) for p in got} <= want and _connected(got) == _connected(want)
    assert heavy < 10**9 or got == want
