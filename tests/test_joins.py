import pytest
from pyspark.sql import functions as F

from tessella.operators import joins
from tessella.sources import generators

NODES = {"shuffle_hash": "ShuffledHashJoin", "merge": "SortMergeJoin", "broadcast": "BroadcastHashJoin", "semi_reduced": "LeftSemi"}


@pytest.fixture(scope="module")
def tables(spark):
    r = generators.relation(spark, "age", "R", 100).withColumnRenamed("payload", "r")
    return r, generators.relation(spark, "age", "S", 1000).withColumnRenamed("payload", "s")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_strategies_agree(tables, strategy):
    r, s = tables
    want = sorted((a["key"], a["r"], b["s"]) for a in r.collect() for b in s.collect() if a["key"] == b["key"])
    got = joins.equi_join(r, s, "key", strategy)
    assert rows(got) == want and got.columns == ["key", "r", "s"]
    if strategy in NODES:
        assert NODES[strategy] in got._jdf.queryExecution().executedPlan().toString()


def test_broadcast_falls_back_when_too_large(tables, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1)
    assert "SortMergeJoin" in joins.equi_join(*tables, "key", "broadcast")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy", joins.THETA_STRATEGIES)
def test_theta(tables, strategy):
    r, s = tables[0].select(F.col("key").cast("int").alias("a"), "r"), tables[1].select(F.col("key").cast("int").alias("b"), "s")
    want = sorted((*x, *y) for x in r.collect() for y in s.collect() if x["a"] > y["b"])
    assert rows(joins.theta_join(r, s, "a", "b", strategy)) == want


@pytest.mark.parametrize("strategy", joins.THETA_STRATEGIES)
def test_theta_is_strict_and_skips_nulls(spark, strategy):
    r, s = spark.createDataFrame([(7,), (None,), (8,)], "a int"), spark.createDataFrame([(7,), (None,)], "b int")
    assert rows(joins.theta_join(r, s, "a", "b", strategy)) == [(8, 7)]
    assert rows(joins.theta_join(r.limit(0), s.limit(0), "a", "b", strategy)) == []


def test_filters_keep_duplicates(spark):
    s, r = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("", 3)], "key string, v int"), spark.createDataFrame([("a",), ("a",), ("",)], "key string")
    assert rows(joins.semi_filter(s, r, "key")) == [("", 3), ("a", 1), ("a", 1)]
    assert rows(joins.anti_filter(s.union(s), r, "key")) == [("b", 2), ("b", 2)]


def test_several_keys(spark):
    a, b = spark.createDataFrame([(1, 2, "x")], "k int, l int, v string"), spark.createDataFrame([(1, 2, "y"), (1, 3, "z")], "k int, l int, w string")
    assert rows(joins.equi_join(a, b, ["k", "l"], "merge")) == [(1, 2, "x", "y")]


@pytest.mark.parametrize("strategy", ["shuffle_hash", "merge", "semi_reduced"])
def test_hot_keys_are_dealt_over_tasks(spark, strategy):
    """One key with few rows on the left, one with few on the right, one without pairs, nulls and copies of rows."""
    r = spark.createDataFrame([(1, i) for i in range(20)] + [(2, i) for i in range(400)] + [(3, 1), (None, 2), (5, 1), (5, 1)], "key int, x int")
    s = spark.createDataFrame([(1, i) for i in range(500)] + [(2, i) for i in range(30)] + [(4, 1), (None, 2), (5, 7), (5, 7)], "key int, y int")
    want = sorted((a["key"], a["x"], b["y"]) for a in r.collect() for b in s.collect() if a["key"] is not None and a["key"] == b["key"])
    got = joins.equi_join(r, s, "key", strategy, pairs=500)
    assert rows(got) == want and got.columns == ["key", "x", "y"]
    tasks = got.groupBy("key", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert max(t["n"] for t in tasks) < 3000 and len({t["p"] for t in tasks if t["key"] == 1}) > 5


@pytest.mark.parametrize("strategy", ["nested_loop", "ranges"])
def test_theta_pairs_are_dealt_over_tasks(spark, monkeypatch, strategy):
    monkeypatch.setattr(joins, "TESTED", 10_000)
    monkeypatch.setattr(joins, "PAIRS", 10_000)
    r, s = spark.range(300).selectExpr("id AS a").coalesce(1), spark.range(500).selectExpr("id AS b").coalesce(1)
    got = joins.theta_join(r, s, "a", "b", strategy, 2)
    tasks = [t["n"] for t in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 300 * 299 // 2 and max(tasks) < 16_000
