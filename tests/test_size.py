"""What grows with the tables or with the rounds of a loop."""

import hashlib

from pyspark.sql import functions as F

from ravelin.operators import association, explore, graph, layout, overlap
from ravelin.runtime import cut


def test_guessed_size_stays_bounded(spark):
    t = cut(spark.range(20).select("id", F.col("id").alias("next")))
    for _ in range(6):
        t = cut(t.join(t.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")))
    assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert sorted((r.id, r.next) for r in t.collect()) == [(i, i) for i in range(20)]
    assert t.join(t.select("id"), "id").count() == 20  # a rebuilt table still joins itself


def test_long_chain_of_components(spark):
    name = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(600)]
    pairs = list(zip(name[:400], name[1:401])) + list(zip(name[401:], name[402:]))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: min(name[:401]) if i < 401 else min(name[401:]) for i, x in enumerate(name)}


def test_shuffles_of_a_cut_leave_the_disk(spark):
    import pathlib

    def kept():
        return {p.name for p in pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data")}

    before = kept()
    t = cut(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert not kept() - before
    assert sum(r.n for r in t.collect()) == 5000


def test_common_item_is_dealt_to_tasks(spark):
    import random

    rnd = random.Random(3)
    sets = {f"r{k:03}": {"all", *rnd.sample("abcdefgh", rnd.randint(1, 4))} for k in range(120)}
    t = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "left string, item string")
    want = sorted((a, b, n) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= 2)
    got = overlap.overlap_edges(t, min_shared=2, share=10)
    assert sorted((r.a, r.b, r.w) for r in got.collect()) == want


def test_fused_tiers_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(it):
        for p in it:
            made.add(len(p))
            yield p

    t = spark.createDataFrame([("a", "b", 1), ("b", "c", 3)], "a string, b string, w long").mapInPandas(seen, "a string, b string, w long")
    assert sorted((r.a, r.b, r.w) for r in association.fused([t]).collect()) == [("a", "b", 0.0), ("b", "c", 1.0)]
    assert made.value == 2


def test_cards_meet_by_name(spark):
    old = spark.createDataFrame([(r, t) for r, ts in {"o1": "xyz", "o2": "xy", "o3": "yz"}.items() for t in ts], "repo string, topic string")
    new = spark.createDataFrame([(r, t) for r, ts in {"n1": "xyz", "n2": "xy"}.items() for t in ts], "repo string, topic string")
    theta = spark.createDataFrame([(t, 0.1) for t in "xyz"], "topic string, theta double")
    edges = explore.card(old, new, theta, 2, 9)[1]
    assert sorted((r.a, r.b, r.w) for r in edges.collect()) == [("n1", "n2", 2), ("n1", "o1", 3), ("n1", "o2", 2), ("n1", "o3", 2), ("n2", "o1", 2), ("n2", "o2", 2)]
    assert "NestedLoop" not in edges._jdf.queryExecution().executedPlan().toString()


def test_communities_in_memory_are_small_and_those_of_tables(spark):
    import random
    import tracemalloc

    rnd = random.Random(5)
    pairs = {(f"n{rnd.randint(0, 4000)}", f"n{rnd.randint(0, 4000)}", float(rnd.randint(1, 9))) for _ in range(16000)}
    e = cut(spark.createDataFrame(sorted(pairs), "a string, b string, w double"))
    tracemalloc.start()
    here = graph.communities(e, 2.0, rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500 * len(pairs)  # bytes of the driver's Python an edge
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, graph.communities(e, 2.0, rounds=3, local_edges=0).collect()))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count(" hashpartitioning(")


def test_object_ids_are_shuffled_once_and_as_bytes(spark, small):
    from ravelin.plans import data

    refs = data.refs(spark, small)
    assert _shuffles(refs) == 1 and refs.schema["object_id"].dataType.typeName() == "binary"
    assert refs.count() == refs.distinct().count() > 0


def test_items_of_keys_without_candidates_do_not_meet(spark):
    pairs = [(k, i) for k in ("a", "b") for i in range(5)] + [("c", i) for i in range(100, 104)] + [("a", 0), ("d", None)]
    refs = spark.createDataFrame(pairs, "origin string, object_id long").repartition(3)
    held = overlap._held(refs, "origin", "object_id")
    assert _shuffles(held) == 1 and held.count() == 14
    candidates = spark.createDataFrame([("a", "b")], "a string, b string")
    got = overlap.containment(candidates, refs)
    assert [(r.a, r.b, r.shared, r.size_a, r.size_b) for r in got.collect()] == [("a", "b", 5, 5, 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") > 0


def _overlaps(sets, least):
    return sorted((a, b, n) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= least)


def test_pairs_of_long_lists_are_not_shuffled(spark):
    import random

    rnd = random.Random(4)
    sets = {f"r{k:02}": set(rnd.sample([f"p{i}" for i in range(60)], rnd.randint(1, 40))) for k in range(50)}
    t = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v for _ in range(2)] + [(None, "p1"), ("r00", None)], "left string, item string")
    for group in (7, 1000):  # with some groups empty or of one key, and with one
        got, n = overlap.dense_overlaps(t, min_shared=5, group=group)
        assert n == len(set().union(*sets.values()))
        assert sorted((r.a, r.b, r.w) for r in got.collect()) == _overlaps(sets, 5)
        assert all((r.ca, r.cb) == (len(sets[r.a]), len(sets[r.b])) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    few, n = overlap.dense_overlaps(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 1), ("d", 9)], "left string, item long"), min_shared=1, least=2, group=1)
    assert sorted(map(tuple, few.collect())) == [("a", "b", 2, 2, 2)] and n == 3


def test_association_of_long_lists_is_that_of_short_ones(spark):
    import random

    rnd = random.Random(6)
    t = spark.createDataFrame([(f"p{p}", f"r{r:02}") for r in range(30) for p in rnd.sample(range(40), rnd.randint(1, 25))] + [("alone", "r00"), ("alone", "r00")], "doc string, item string")
    rows = lambda df: sorted((r.a, r.b, round(r.w, 9)) for r in df.collect())
    dense = association.positive_pmi(t, min_item=5, min_pair=3, dense=True)
    assert rows(dense) == rows(association.positive_pmi(t, min_item=5, min_pair=3)) != []
    assert "Join" not in dense._jdf.queryExecution().executedPlan().toString()


def test_trees_over_many_communities(spark):
    """Rolled up, walked and listed to the same members, with the moves made in memory."""
    rnd = __import__("random").Random(8)
    e = cut(spark.createDataFrame(sorted({(min(p), max(p), float(rnd.randint(1, 9))) for _ in range(300) if len(p := {f"n{rnd.randint(0, 150):03}", f"n{rnd.randint(0, 150):03}"}) == 2}), "a string, b string, w double"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tree = graph.hierarchy(e, nodes, most=2)
    n = nodes.count()
    flat = cut(graph.flat_members(tree))
    top = graph.without_singletons(tree)[1].collect()
    assert sum(r.member_count for r in top) == n
    assert flat.select("member").distinct().count() == n
    roots = {r.path[-2] for r in graph.ancestors(tree).collect()}
    assert {r.id for r in top if r.member_count > 1} <= roots


def test_components_keep_a_row_a_node_in_each_task(spark):
    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(40) if i % 3 == j % 3 and i != j] + [("x", "x"), (None, "n01")]
    e = spark.createDataFrame(pairs, "a string, b string").repartition(2)
    few = cut(graph.stars(e, flush=100))
    assert few.count() <= 2 * 41
    want = {r.node: r.component for r in graph.components(e).collect()}
    assert {r.node: r.component for r in graph.components(few).collect()} == want


def test_rounds_of_eigenvectors_shuffle_nothing(spark):
    import math
    import random

    rnd = random.Random(4)
    pairs = {tuple(sorted(rnd.sample(range(200), 2))) for _ in range(900)} | {(i, i + 1) for i in range(199)}
    rows = [(f"n{a:03}", f"n{b:03}", 1 + rnd.random()) for a, b in sorted(pairs)]
    rows += [(b, a, w / 2) for a, b, w in rows[:50]] + [("n000", "n001", None), ("other", "pair", 1.0)]  # of repeated edges the greatest holds
    e = spark.createDataFrame(rows, "a string, b string, w double").repartition(3)
    got = {}
    for normalised in (True, False):
        for way, kept in {"dense": {}, "packed": {"dense": 2}}.items():
            spark.sparkContext.setJobGroup(f"{way}{normalised}", way)
            got[way] = {r.node: (r.r * math.cos(r.theta), r.r * math.sin(r.theta)) for r in layout.spectral(e, normalised, **kept).collect()}
        spark.sparkContext.setJobGroup("rest", "rest")
        assert got["dense"].keys() == got["packed"].keys() and len(got["dense"]) == 200
        assert all(math.dist(got["dense"][k], got["packed"][k]) < 1e-3 for k in got["dense"])
        ids = [len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) for j in spark.sparkContext.statusTracker().getJobIdsForGroup(f"packed{normalised}")]
        assert len(ids) - ids.count(1) < 60  # before, each round had several jobs with a shuffle


def test_edges_of_communities_do_not_come_to_the_driver(spark):
    import tracemalloc

    e = cut(spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 997).alias("a"), F.concat(F.lit("n"), (F.col("id") * 7) % 1009).alias("b"), F.lit(1.0).alias("w")))
    tracemalloc.start()
    got = graph.communities(e, 2.0, rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 20_000  # bytes of the driver's Python an edge
    assert "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == got.select("node").distinct().count() > 1000
    assert graph.communities(e.limit(0)).count() == 0


def test_paths_without_kept_edges_are_the_same(spark):
    import random

    rnd = random.Random(8)
    sets = {f"r{k:02}": rnd.sample("abcdefghij", rnd.randint(3, 5)) for k in range(24)}
    t = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "left string, item string")
    chain = [(f"r{k:02}", f"x{k:02}") for k in (3, 7)] + [("x03", "y03"), ("y03", "y07"), ("x07", "y07"), ("zz", "zy")]
    other = cut(spark.createDataFrame(chain, "a string, b string").withColumn("tier", F.lit("chain")).withColumn("rank", F.lit(0)))
    tags = overlap.overlap_edges(t, min_shared=4)
    tiers = cut(other.unionByName(tags.select("a", "b", F.lit("tags").alias("tier"), F.lit(3).alias("rank"))))
    lists = overlap.coded_lists(t, 4)
    known = [r.left for r in t.select("left").distinct().orderBy("left").collect()]
    made = overlap.edges_of(spark.createDataFrame([(k,) for k in known], "node string"), lists, 4)
    both = {(r.a, r.b) for r in tags.collect()}
    assert sorted(map(tuple, made.collect())) == sorted(both | {(b, a) for a, b in both}) and both
    ways = cut(tiers.where("rank = 0").select(F.col("a").alias("u"), F.col("b").alias("v"), "tier", "rank").unionByName(tiers.where("rank = 0").select(F.col("b").alias("u"), F.col("a").alias("v"), "tier", "rank")))

    def near(nodes):
        e = overlap.edges_of(nodes, lists, 4).select("u", "v", F.lit("tags").alias("tier"), F.lit(3).alias("rank"))
        return ways.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").unionByName(e)

    ends = sorted({x for r in tiers.collect() for x in (r.a, r.b)})
    for x, y in [(ends[0], ends[-3]), (ends[-3], ends[2]), ("x03", "x07"), (ends[1], ends[1]), ("r00", "zz")]:
        got = graph.path_between(near, lambda k: spark.createDataFrame([(k,)], "node string"), x, y)
        assert got == sorted(map(tuple, graph.shortest_path(tiers, x, y).collect())), (x, y)


def test_pairs_with_common_tags_are_not_kept_for_a_path(spark, small, monkeypatch):
    from ravelin.plans import maps

    monkeypatch.setattr(maps.overlap, "overlap_edges", None)
    assert [r.hop for r in maps.g17_shortest_path(spark, small).orderBy("hop").collect()][:1] == [0]


def test_edges_of_a_tree_do_not_come_to_the_driver(spark):
    import tracemalloc

    e = cut(spark.range(20_000).select(F.concat(F.lit("n"), F.col("id") % 997).alias("a"), F.concat(F.lit("n"), (F.col("id") * 7) % 1009).alias("b"), (1.0 + F.col("id") % 5).alias("w")).groupBy("a", "b").agg(F.max("w").alias("w")))
    tracemalloc.start()
    tree = graph.hierarchy(e, e.select(F.col("a").alias("node")), levels=1, k=100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * e.count() and tree.count() == 997  # bytes of the driver's Python an edge
