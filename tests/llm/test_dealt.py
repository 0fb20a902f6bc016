"""The operators of the subpackage against brute force, with nulls, empty tables, ties, repeats and clashing names."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import audiences, groups, mixing, neighbours, similar, spans, survivors, together, tokens


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- groups


def _union(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return sorted((x, find(x)) for x in parent)


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 200 + i) for i in range(50)] + [(5, 5), (300, 300)]
    e = spark.createDataFrame([(a, b, 1, 2) for a, b in pairs] + [(None, 3, 1, 1), (4, None, 1, 1)], "a long, b long, u long, component long")
    assert rows(groups.components(e), "node", "component") == _union(pairs)
    assert groups.components(e.where("a < -1")).count() == 0


def test_containment_links_all_copies(spark):
    sets = {"x": "abcdefghij", "y": "abcdefghijklmnop", "z": "abcdefghij", "w": "qr", "v": "qrst", "u": "q", "t": "abcdefghiX", "s": ""}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, i array<string>")
    got = {tuple(sorted((r.a, r.b))) for r in groups.contained_pairs(df, "k", "i", 2, 0.9).collect()}
    want = set()
    for a, b in itertools.combinations(sets, 2):
        n = len(set(sets[a]) & set(sets[b]))
        if n >= 2 and n >= 0.9 * min(len(sets[a]), len(sets[b])) - 1e-9:
            want.add(tuple(sorted((a, b))))
    assert _union(got) == _union(want) and got <= want


@pytest.mark.parametrize("heavy", [4, 10**9])
def test_near_copies_are_connected(spark, monkeypatch, heavy):
    monkeypatch.setattr(groups, "HEAVY", heavy)
    rnd = random.Random(8)
    base = [f"b{i:02d}" for i in range(30)]
    sets = {f"n{i:02d}": set(base) - {base[i % 30]} | {f"own{i}"} for i in range(40)}
    sets |= {f"m{i}": set(rnd.sample(base, 12)) | {f"x{i}{j}" for j in range(rnd.randint(0, 3))} for i in range(12)} | {"hub": {"b00", "b01", *(f"h{i}" for i in range(60))}, "two": {"h1", "h2"}}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k string, i array<string>")
    got = {tuple(sorted((r.a, r.b))) for r in groups.contained_pairs(df, "k", "i", 2, 0.9).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= max(2, 0.9 * min(len(sets[a]), len(sets[b])) - 1e-9)}
    assert _union(got) == _union(want) and got <= want


def test_repository_groups(spark):
    pages = "repo string, full_name string, fork boolean, parent_full_name string, status string, fetched_at long, group_id string"
    p = [
        ("A/one", "a/two", False, None, "ok", 2, "x"),
        ("a/ONE", "a/other", False, None, "ok", 1, "x"),
        ("a/two", None, None, None, "error", 9, "x"),
        ("b/f", "b/f", True, "Ghost/Up", "ok", None, "x"),
        ("b/g", "b/g", True, "ghost/up", "ok", 1, "x"),
        ("c/n", "c/n", False, "a/two", "ok", 1, "x"),
        (None, "a/two", False, None, "ok", 1, "x"),
        ("a/one", "a/two", False, None, "ok", 2, "x"),
    ]
    refs = spark.createDataFrame([("z/1", ["F" * 40, "e" * 40, "bad", None], None, 1), ("Z/2", ["f" * 40, "E" * 40], None, 1), ("z/2", ["a" * 40], "timeout", 5), ("z/3", None, None, 1)], "repo string, ids array<string>, error string, fetched_at long")
    got = rows(groups.repository_groups(spark.createDataFrame(p, pages), refs), "repo", "group_id")
    assert got == [("a/one", "a/one"), ("a/two", "a/one"), ("b/f", "b/f"), ("b/g", "b/f"), ("z/1", "z/1"), ("z/2", "z/1")]
    none = groups.repository_groups(spark.createDataFrame([], pages), refs.where("repo = ''"))
    assert none.count() == 0


# ---------------------------------------------------------------- survivors


def test_follow_with_chain_and_ring(spark):
    moves = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("p", "q"), ("q", "r"), ("r", "q"), ("s", "s"), ("t", None)]
    got = dict(rows(survivors.follow(spark.createDataFrame(moves, "src string, dst string")), "src", "dst"))
    assert got == {**{f"n{i:02d}": "n20" for i in range(20)}, "p": "q", "q": "q", "r": "q"}


def test_survivors_fill_from_later_layers(spark):
    rec = [("g", "old", "T", 5, 1), ("g", "new", None, 9, 3), ("g", "mid", "U", None, 2), ("h", "x", None, None, 1), (None, "y", "V", 1, 1)]
    df = spark.createDataFrame(rec, "grp string, id string, title string, n long, at long")
    q = lambda c: F.col(c).isNotNull().cast("int")
    out = survivors.survivors(df, "grp", {"title": (F.col("title"), q("title")), "n": (F.col("n"), q("n"))}, [F.col("at"), F.col("id")])
    assert rows(out, "grp", "title", "n") == [("g", "U", 9), ("h", None, None)]
    only_n = survivors.survivors(df, "grp", {"title": (F.col("title"), q("title")), "n": (F.col("n"), q("n"))}, [F.col("at"), F.col("id")], compare=["n"])
    assert rows(only_n.where("grp = 'g'"), "title", "n", "layers") == [("U", 9, 2)]
    assert survivors.survivors(df.where("at > 9"), "grp", {"n": (F.col("n"), q("n"))}, [F.col("id")]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_surviving_repositories(spark, seed):
    rnd = random.Random(seed)
    names = [f"o/r{i}" for i in range(8)]
    pages = [(n, rnd.choice(names), "ok", rnd.randint(1, 3), None) for n in names[:5] for _ in range(2)]
    pages = list({(n, t): (n, f, s, t, x) for n, f, s, t, x in pages}.values())
    recs = [(i, rnd.choice([" {} ", "https://git.example/{}/", "{}.git", "{}"]).format(rnd.choice(names).upper()), rnd.choice([None, "", "TBD", "r1", " Good ", "Fine", "-"]), rnd.choice([None, -1, 10000, 5, 77]), rnd.choice([None, 1, 2])) for i in range(40)]
    ps = spark.createDataFrame(pages, "repo string, full_name string, status string, fetched_at long, current_name string")
    rs = spark.createDataFrame(recs + recs[:5], "rec_id long, repo string, title string, stargazers long, fetched_at long")
    move = {}
    for n, f, _, t, _ in sorted(pages, key=lambda p: (p[3], p[1])):
        move[n] = f

    def end(n):
        seen = []
        while n not in seen and move.get(n, n) != n:
            seen.append(n)
            n = move[n]
        return min(seen[seen.index(n) :]) if n in seen else n

    want, by = [], {}
    for r in recs:
        slug = r[1].strip().lower().removeprefix("https://git.example/").rstrip("/").removesuffix(".git")
        by.setdefault(end(slug), []).append((r, slug))
    for g, rr in by.items():
        rr.sort(key=lambda x: (x[0][4] is None, -(x[0][4] or 0), -x[0][0]))
        t = next((x[0][2].strip() for x in rr if x[0][2] and x[0][2].strip() and x[0][2].strip().lower() not in ("tbd", "-", x[1].split("/")[-1])), None)
        s = next((x[0][3] for x in rr if x[0][3] not in (None, -1, 10000)), 10000 if any(x[0][3] == 10000 for x in rr) else None)
        if len(rr) > 1 and t is not None and s is not None:
            want.append((g, t, s))
    assert rows(survivors.surviving_repositories(rs, ps), "current_name", "title", "stargazers") == sorted(want)


# ---------------------------------------------------------------- similar


@pytest.mark.parametrize("leaf", [2, 48])
def test_similar_pairs(spark, leaf):
    rnd = random.Random(4)
    base = [{f"t{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(1, 12))} for _ in range(60)]
    sets = base + [set(list(s)[1:]) | ({"x"} if i % 3 == 0 else set()) for i, s in enumerate(base)] + [{"hot", "a", "b", "c", "d"} | {f"u{i}"} for i in range(30)] + [{"hot", "a", "b", "c", "d"}] * 3
    data = [(i, i % 2 and "p" or "q", sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data] + [(None, "p", ["a"], 1, 2), (900, "p", None, 1, 2), (901, "p", [], 1, 2), (*data[0], 1, 2)], "id long, tab string, items array<string>, a long, _c long")
    want = sorted((t, i, j) for (i, t, x), (j, u, y) in itertools.combinations(data, 2) if t == u and x and y and len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y)) - 1e-9)
    assert rows(similar.similar_pairs(df, "id", "items", 0.7, scope="tab", leaf=leaf), "tab", "a", "b") == want
    assert similar.similar_pairs(df.where("id < 0"), "id", "items", 0.7).count() == 0


def test_similar_pairs_of_many_near_copies(spark):
    rnd = random.Random(6)
    core = [f"c{i}" for i in range(60)]
    sets = [set(core) - set(rnd.sample(core, rnd.randint(1, 8))) | {f"o{i}" for _ in range(2)} for i in range(150)]
    sets += [{f"z{rnd.randint(0, 300)}" for _ in range(20)} | set(rnd.sample(core, 3)) for _ in range(150)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, items array<string>")
    want = sorted((i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2) if len(x & y) >= 0.7 * len(x | y) - 1e-9)
    assert rows(similar.similar_pairs(df, "id", "items", 0.7), "a", "b") == want and len(want) > 10000


def test_clean_items(spark):
    df = spark.createDataFrame([([" A ", "a", None, " ", "b\t"],), (None,), ([],)], "i array<string>")
    assert [r.c for r in df.select(similar.clean_items(F.col("i")).alias("c")).collect()] == [["a", "b"], None, []]


# ---------------------------------------------------------------- neighbours


def test_nearest(spark):
    rnd = np.random.default_rng(0)
    centre = rnd.normal(size=(20, 16))
    x = (centre[rnd.integers(0, 20, 400)] + 0.3 * rnd.normal(size=(400, 16))).astype(np.float32)
    x[50:62] = x[50]  # copies
    x[70] = x[71] * np.float32(2)  # the same direction
    data = [(i, [float(v) for v in row], "c", 1) for i, row in enumerate(x)]
    bad = [(1000, None, "c", 1), (1001, [0.0] * 16, "c", 1), (1002, [1.0] * 15, "c", 1), (1003, [float("nan")] + [1.0] * 15, "c", 1), (1004, [None] + [1.0] * 15, "c", 1), (None, [1.0] * 16, "c", 1), (1005, [float("inf")] + [1.0] * 15, "c", 1)]
    df = spark.createDataFrame(data + bad + data[:3], "id long, v array<float>, h string, block int")
    got = rows(neighbours.nearest(df, "id", "v", 5, dim=16), "id", "rank", "other")
    y = neighbours.unit(x)
    want = []
    for i in range(len(x)):
        c = np.round(y @ y[i], 6)
        c[i] = -9
        order = np.lexsort((np.arange(len(x)), -c))[:5]
        want += [(i, r + 1, int(j)) for r, j in enumerate(order)]
    assert len(set(got) & set(want)) >= 0.98 * len(want) and len(got) == len(want)
    assert [t for t in got if t[0] in range(50, 62)] == [t for t in want if t[0] in range(50, 62)]
    assert neighbours.nearest(df.where("id < 0"), "id", "v", 5, dim=16).count() == 0
    two = rows(neighbours.nearest(df.where("id in (1, 2)"), "id", "v", 5, dim=16), "id", "other")
    assert two == [(1, 2), (2, 1)]


@pytest.mark.parametrize("noise", [0.0, 1e-5])
def test_nearest_of_many_scaled_copies(spark, noise):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(1500, 16))
    copies = np.arange(2, 1500, 3)  # a third of the rows
    x[copies] = x[2] * rnd.uniform(0.1, 9, size=(len(copies), 1)) * (1 + noise * rnd.normal(size=(len(copies), 16)))
    x = x.astype(np.float32)
    ids = rnd.permutation(1500)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, v array<float>")
    got = {}
    for r in neighbours.nearest(df, "id", "v", 5, dim=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    low = sorted(ids[copies].tolist())[:6]
    assert all(got[i] == [j for j in low if j != i][:5] for i in ids[copies].tolist())


def test_nearest_over_many_blocks(spark, monkeypatch):
    """Small clusters over many more cells than a vector visits: halves that cells have parted are found."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "WORDS", 8)
    monkeypatch.setattr(neighbours, "CELL", 16, raising=False)
    rnd = np.random.default_rng(8)
    centre = rnd.normal(size=(250, 96))
    x = (np.repeat(centre, 8, axis=0) + rnd.uniform(0.3, 0.55, size=(2000, 1)) * rnd.normal(size=(2000, 96))).astype(np.float32)
    ids = rnd.permutation(2000)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, v array<float>")
    got = set(rows(neighbours.nearest(df, "id", "v", 5, dim=96, reach=1), "id", "other"))
    y = neighbours.unit(x)
    cos = np.round(y @ y.T, 6)
    np.fill_diagonal(cos, -9)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in np.lexsort((ids, -cos[i]))[:5]}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_blocks_split_large_cells():
    cells, size, first, many = neighbours.layout({5: 10, 7: 5000, 9: 3}, 256)
    assert cells.tolist() == [5, 7, 9] and many.tolist() == [1, 3, 1] and first.tolist() == [0, 1, 4]


# ---------------------------------------------------------------- together


def test_poisson_binomial_tail():
    q, n = np.array([0.1, 0.5, 0.03]), np.array([4, 3, 6])
    dist = np.ones(1)
    for qi, ni in zip(q, n):
        for _ in range(ni):
            dist = np.convolve(dist, [1 - qi, qi])
    for k in range(0, 15):
        assert together.poisson_binomial_tail(k, q, n) == pytest.approx(dist[k:].sum() if k else 1.0, rel=1e-9, abs=1e-15)


def test_tails_of_large_counts(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = rng.integers(1, 8)
        q, n = rng.random(m) ** 3, rng.integers(1, 300, m)
        k = int(np.clip((n * q).sum() + 5 * rng.normal() * np.sqrt((n * q * (1 - q)).sum()), 1, n.sum()))
        monkeypatch.setattr(together, "SHORT", 10**9)
        direct = together.poisson_binomial_tail(k, q, n)
        monkeypatch.setattr(together, "SHORT", 0)
        assert together.poisson_binomial_tail(k, q, n) == pytest.approx(direct, rel=1e-10, abs=1e-290)
    many = together.poisson_binomial_tail(100_050_000, np.full(30, 0.1), np.full(30, 33_350_000))
    assert many == pytest.approx(0.5, abs=1e-3) and together.poisson_binomial_tail(10**8 + 10**6, np.full(3, 0.1), np.full(3, 333_333_334)) < 1e-300


def test_null_honours_frequencies_and_sizes():
    f, m, s, n = np.array([1, 3, 10]), np.array([6, 4, 1]), np.array([1, 2, 4]), np.array([10, 5, 2])
    x, y = together.fit_null(f, m, s, n)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    in_parts = together.fit_null(f, m, s, n, rows=2)
    assert np.allclose(in_parts[0], x, rtol=1e-12) and np.allclose(in_parts[1], y, rtol=1e-12)
    assert np.allclose((p * n).sum(1), f, rtol=1e-5) and np.allclose((p * m[:, None]).sum(0), s, rtol=1e-5)


def test_surprising_pairs(spark):
    rnd = random.Random(1)
    b = [(i, sorted({f"t{int(rnd.paretovariate(0.8)) % 40:02d}" for _ in range(rnd.randint(0, 8))} | ({"x", "y"} if i % 20 == 0 else set()))) for i in range(300)] + [(900, [f"z{i:03d}" for i in range(90)])]
    df = spark.createDataFrame([(*r, "n") for r in b] + [(901, None, "n"), (902, [], "n")], "id long, items array<string>, item string")
    sets = [set(x) for _, x in b if x]
    got = {(r.a, r.b): r for r in together.surprising_pairs(df, "id", "items", 3, 1.5).collect()}
    c = lambda *t: sum(set(t) <= s for s in sets)
    items = sorted(set().union(*sets))
    want = {(p, q) for p, q in itertools.combinations([i for i in items if c(i) >= 3], 2) if c(p, q) >= 3 and c(p, q) * len(sets) >= 1.5 * c(p) * c(q)}
    assert set(got) == want and got[("x", "y")].n_ab == c("x", "y") and got[("x", "y")].significant
    ps = sorted((r.p_value, k) for k, r in got.items())
    tests = len(items) * (len(items) - 1) / 2
    q = [min(1.0, min(p2 * tests / (sum(p3 <= p2 for p3, _ in ps)) for p2, _ in ps[i:])) for i, (p, _) in enumerate(ps)]
    assert all(got[k].q_value == pytest.approx(v, rel=1e-9) for (_, k), v in zip(ps, q))
    one = together.surprising_pairs(df.where("id = 900"), "id", "items")
    assert one.count() == 90 * 89 // 2  # a long basket, in slices
    assert together.surprising_pairs(df.where("id < 0"), "id", "items").count() == 0


def test_pair_report_has_every_pair(spark, small):
    from ravelin.llm import queries

    baskets = [set(r["items"]) for r in queries._sets(spark, small, "topics", "record_id", "topics", "fetched_at").collect()]
    want = {p for b in baskets for p in itertools.combinations(sorted(b), 2)}
    got = {(r.a, r.b): r for r in queries.p6_pairs(spark, small).collect()}
    assert set(got) == want and all(r.n_ab == sum(set(k) <= b for b in baskets) for k, r in got.items())
    items = len(set().union(*baskets))
    ps = np.array([r.p_value for r in got.values()])
    rank = np.searchsorted(np.sort(ps), ps, side="right")
    order = np.argsort(ps)
    q = np.minimum(1, np.minimum.accumulate((ps * items * (items - 1) / 2 / rank)[order][::-1])[::-1])
    assert np.allclose(np.array([r.q_value for r in got.values()])[order], q, rtol=1e-9)


# ---------------------------------------------------------------- audiences


@pytest.mark.parametrize("block", [3, 256])
def test_overlaps(spark, monkeypatch, block):
    monkeypatch.setattr(audiences, "BLOCK", block)
    rnd = random.Random(6)
    sets = {f"s{i}": {int(rnd.paretovariate(0.5)) % 500 for _ in range(rnd.randint(1, 80))} for i in range(12)}
    data = [(k, f"m{v}", 7) for k, s in sets.items() for v in s]
    df = spark.createDataFrame(data + data[:20] + [(None, "m1", 7), ("s1", None, 7)], "k string, m string, size long")
    want = sorted((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b])
    assert rows(audiences.overlaps(df, "k", "m"), "a", "b", "common", "size_a", "size_b") == want
    assert audiences.overlaps(df.where("k = 'none'"), "k", "m").count() == 0


def test_dense_containers(spark, monkeypatch):
    monkeypatch.setattr(audiences, "BLOCK", 2)
    monkeypatch.setattr(audiences, "LANE_BYTES", 4096)
    sets = {"a": range(0, 140000), "b": range(60000, 140000, 2), "c": range(5, 140000, 997), "d": range(100, 5000), "e": range(139990, 140050)}
    df = None
    for k, s in sets.items():
        part = spark.range(s.start, s.stop, s.step).select(F.lit(k).alias("k"), F.col("id").alias("m"))
        df = part if df is None else df.unionByName(part)
    want = sorted((a, b, len(set(sets[a]) & set(sets[b])), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if set(sets[a]) & set(sets[b]))
    assert rows(audiences.overlaps(df, "k", "m"), "a", "b", "common", "size_a", "size_b") == want
    for n in (0, 1, 4095, 4096, 65536):
        low = np.sort(np.random.default_rng(n).permutation(65536)[:n]).astype(np.uint16)
        assert audiences.unpack(audiences.pack(low)).tolist() == low.tolist() and len(audiences.pack(low)) <= 8192


# ---------------------------------------------------------------- tokens

TEXTS = [None, "", " ", "a", "it's  we'll\r\n\n\n x", "<|endoftext|> x", "日本語のテキスト" * 40, "é́ \U0001f600‍\U0001f525" * 60, "x" * 5000, " " * 700 + "y", "  " * 300, "\x1c\x1d a" * 90, "can't" * 200, "1234567890" * 90, "def f(x):\n    return x\n\n" * 60, "\n" * 400 + "Version", "a.b,c;d:e!" * 80]


def test_ids_are_exact(spark):
    rnd = random.Random(0)
    mixed = ["".join(rnd.choice(["word", " ", "\n\n", "  ", "'s", "é", "1", "...", "漢", " ", "X", "'"]) for _ in range(rnd.randint(50, 900))) for _ in range(60)]
    texts = TEXTS + mixed + mixed[:3]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(df).collect()}
    enc = tokens.encoder(tokens.rank_file())
    assert len(got) == len(texts)
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert tokens.encode_documents(df.where("doc_id < 0")).count() == 0


def test_ids_of_repeated_rows_and_null_keys(spark):
    rnd = random.Random(7)
    long = ["".join(rnd.choice(["word", " ", "\n\n", "'s", "é", "1", "漢", "字"]) for _ in range(900)) for _ in range(2)]
    data = [(1, long[0]), (1, long[0]), (1, long[1]), (None, long[0]), (None, long[1]), (2, ""), (2, None), (3, "漢字" * 3000)]
    enc = tokens.encoder(tokens.rank_file())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in tokens.encode_documents(spark.createDataFrame(data, "doc_id long, text string")).collect())
    want = {(i is None, i or 0, tuple(enc.encode_ordinary(t or ""))) for i, t in data}
    assert got == sorted((a, b, list(c)) for a, b, c in want)


def test_ids_of_a_very_long_text(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice(["word ", "more  ", "\n", "é", "漢字", "x1"]) for _ in range(150_000))
    got = tokens.encode_documents(spark.createDataFrame([(1, long), (2, long[1000:])], "doc_id long, text string")).collect()
    enc = tokens.encoder(tokens.rank_file())
    assert {r.doc_id: r.ids for r in got} == {1: enc.encode_ordinary(long), 2: enc.encode_ordinary(long[1000:])}


def test_joins_at_every_place():
    j = tokens.Joiner(tokens.rank_file())
    for t in ["it's  we'll\r\n\n  don't stop 12ab..'s ", "a\n\nb  c\t\t d", "x'", " 'll  'l l  z"]:
        for p in range(len(t) + 1):
            for q in range(p, len(t) + 1):
                parts = [t[:p], t[p:q], t[q:]]
                assert j.join(parts, [j.ids(x) for x in parts]) == j.ids(t)


def test_cuts_depend_on_content():
    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    a, b = "left " * 37 + shared, "another start" * 11 + shared
    ends = lambda t: {e - len(t) for e in tokens.cut_points(t)}
    assert len(ends(a) & ends(b)) > 5


# ---------------------------------------------------------------- mixing


def test_mix(spark):
    rnd = random.Random(1)
    docs = [(i, rnd.choice(["A", "a ", "b", "c", None, "other"]), rnd.randint(0, 30), rnd.choice([None, 0.0, 1.0, float("nan")])) for i in range(600)]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, source string, tokens long, weight double, size long")
    tg = spark.createDataFrame([("a", 0.5, 1), ("B", 0.45, 9), ("c", 0.04, 2), ("gone", 0.01, 2), (None, 0.3, 1), ("z", None, None)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, tg)
    got = {r.doc_id: r for r in m.collect()}
    norm = lambda s: s.strip().lower() if s else None
    listed = {i: n for i, s, t, w in docs for n in [norm(s)] if n in ("a", "b", "c")}
    assert {i: r.source for i, r in got.items()} == listed
    total = sum(r.tokens for r in got.values())
    for s, share, most in (("a", 0.5, 1), ("b", 0.45, 9), ("c", 0.04, 2)):
        mine = [r for r in got.values() if r.source == s]
        size = sum(r.tokens for r in mine)
        used = sum(r.tokens * r.uses for r in mine)
        assert max(r.uses for r in mine) - min(r.uses for r in mine) <= 1 and max(r.uses for r in mine) <= most
        assert abs(used - min(share * total, most * size)) <= 30
    rep = {r.source: r for r in mixing.shares(m, tg).collect()}
    assert set(rep) == {"a", "b", "c", "gone", "z"} and rep["gone"].mixed_tokens == 0 and abs(rep["b"].actual_share - 0.45) < 0.05
    assert mixing.mix(df.where("doc_id < 0"), tg).count() == 0 and mixing.mix(df, tg.where("source = 'x'")).count() == 0


def test_heavier_documents_are_preferred(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("tokens"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    tg = spark.createDataFrame([("s", 0.25, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, tg).where("uses > 0").select((F.col("doc_id") % 2).alias("odd")).groupBy("odd").count().collect()
    n = {r.odd: r["count"] for r in got}
    assert n[0] + n[1] == 1000 and n[0] > 2.5 * n[1]


# ---------------------------------------------------------------- spans


def _brute(docs, least):
    seen = {}
    for i, t in docs:
        for s in range(max(0, len(t or "") - least + 1)):
            seen.setdefault(t[s : s + least], set()).add(i)
    out = []
    for i, t in docs:
        mark = [False] * len(t or "")
        for s in range(max(0, len(t or "") - least + 1)):
            if len(seen[t[s : s + least]]) > 1:
                mark[s : s + least] = [True] * least
        at = 0
        for flag, run in itertools.groupby(mark):
            n = len(list(run))
            if flag:
                out.append((i, at, at + n))
            at += n
    return sorted(out)


def test_shared_spans(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdef é漢😀 \n") for _ in range(n))
    p, q = word(200), word(450)
    docs = [(0, word(300) + p + word(50)), (1, p), (2, q + word(30) + p[:-1]), (3, word(10) + q), (4, p + word(100) + p), (5, "ab" * 400), (6, "ab" * 350 + "c"), (7, None), (8, ""), (9, word(199)), (10, word(700) * 2), (11, q[:220] + q[200:450]), (12, "x" * 1000), (13, "x" * 199)]
    docs += [(20 + i, word(20) + q[100:330] + word(20)) for i in range(30)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, start_char long, _doc long")
    assert rows(spans.shared_spans(df), "doc_id", "start_char", "end_char") == _brute(docs, 200)
    part = {r.doc_id: r for r in spans.shared_fraction(df, spans.shared_spans(df)).collect()}
    assert len(part) == len(docs) and part[1].shared_fraction == 1.0 and part[7].shared_chars == 0
    assert spans.shared_spans(df.where("doc_id < 0")).count() == 0


def test_spans_over_many_shards_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_PHRASES", 2)
    monkeypatch.setattr(spans, "LANE_CHARS", 700)
    monkeypatch.setattr(spans, "parts", lambda _: 1)
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefghij klm漢") for _ in range(n))
    passages = [word(rnd.choice([200, 230, 400, 900])) for _ in range(12)]
    docs = [(i, "".join(x for _ in range(rnd.randint(1, 4)) for x in (word(rnd.randint(0, 120)), rnd.choice(passages)[rnd.randint(0, 40) :]))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spans.shared_spans(df), "doc_id", "start_char", "end_char") == _brute(docs, 200)


def test_spans_of_very_long_texts(spark):
    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefgh ijklmn漢😀") for _ in range(600_000))
    b = a[100_000:500_000] + "".join(rnd.choice("opqrst") for _ in range(300)) + a[:250]
    same = "y" * 700_000
    df = spark.createDataFrame([(1, a), (2, b), (2, b), (3, same), (4, same[:300_000])], "doc_id long, text string")
    assert rows(spans.shared_spans(df), "doc_id", "start_char", "end_char") == [(1, 0, 250), (1, 100_000, 500_000), (2, 0, 400_000), (2, 400_300, 400_550), (3, 0, 700_000), (4, 0, 300_000)]


@pytest.mark.parametrize("block", [200, 1000])
def test_pieces_hold_every_window_once(monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab漢") for _ in range(n)) for n in (0, 199, 200, 201, 399, 400, 1999)]
    seen = [(i, o + s, p[s : s + 200]) for i, t in enumerate(texts) for _, o, p, _, _ in spans._cut_text(i, t, 200) for s in range(len(p) - 199)]
    assert sorted(seen) == [(i, s, t[s : s + 200]) for i, t in enumerate(texts) for s in range(len(t) - 199)]
    assert all(len(p[2]) <= block + 199 for i, t in enumerate(texts) for p in spans._cut_text(i, t, 200))


def test_rolling_hash_and_winnow():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 3, 300).astype(np.uint32)
    for width in (1, 2, 5, 64, 200):
        h = spans.rolling(x, width, 12345)
        keys = {}
        assert len(h) == len(x) - width + 1
        for i in range(len(h)):
            assert keys.setdefault(x[i : i + width].tobytes(), h[i]) == h[i]
        assert len(set(keys.values())) == len(keys)
    h = rnd.integers(0, 50, 200).astype(np.uint64)
    for width in (1, 3, 8, 137):
        assert spans.winnow(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
    assert math.isclose(1, 1)
