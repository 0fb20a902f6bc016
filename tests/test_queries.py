"""Every core query runs on the smallest tables and gives the columns its SQL names."""

import duckdb
import pytest

from ravelin.plans import registry

SLOW = {"g10_hierarchy", "g11_top_level", "g12_members", "g19_tree_paths"}


@pytest.fixture(scope="module")
def con(small):
    import os

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in os.listdir(small):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{small}/{t}'")
    return c


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in SLOW])
def test_query(spark, con, small, name):
    df = registry.queries()[name](spark, small)
    n = df.count()
    sql = registry.oracles().get(name)
    if sql:
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns) and len(rel.fetchall()) == n


def test_topic_means_cover_the_table(spark, con, small):
    from ravelin.plans import data

    name = "a18_topic_means"
    got = sorted(map(tuple, registry.queries()[name](spark, small).select("repo", "theta", "r").collect()))
    want = sorted(con.sql(registry.oracles()[name]).fetchall())
    assert {g[0] for g in got} == {r.repo for r in data.repo_topics(spark, small).collect()}
    assert all(g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=2e-6) for g, w in zip(got, want, strict=True))


def test_flagship(spark, small):
    assert registry.flagship(spark, small).count() > 0
