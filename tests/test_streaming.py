from ravelin.streaming import incremental


def test_latest_versions_follow_files(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    schema = "id long, at long, v string"
    for rows in ([(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (2, 9, "c"), (3, 1, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.maintained(incremental.file_stream(spark, src, schema), state, ck, incremental.latest_versions(["id"], ["at"], ["v"])).awaitTermination(120)
    assert sorted((r.id, r.v) for r in incremental.current(spark, state).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_aliases_accumulate(spark):
    old = spark.createDataFrame([("a", "b"), ("x", "y")], "alias string, canon string")
    new = spark.createDataFrame([("b", "c"), ("x", "z")], "alias string, canon string")
    assert sorted((r.alias, r.canon) for r in incremental.alias_merge(old, new).collect()) == [("a", "c"), ("b", "c"), ("x", "z")]


def test_windows(spark, small):
    t = spark.read.parquet(f"{small}/events.parquet")
    assert sum(r.n for r in incremental.windowed_counts(t, "ts", "event_type").collect()) == t.count()
