"""Plans: what reaches the scan, which join runs, and what stored layouts save."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as op
from millrace.sources import columnar


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("g"), F.lit("x").alias("t"))
    return columnar.store(df, str(tmp_path_factory.mktemp("stored") / "t"), ["k"], ["g"])


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(op.lookup(stored, "k", 7).select("k", "g"))
    assert "EqualTo(k,7)" in text and "ReadSchema: struct<k:bigint,g:bigint>" in text
    assert "GreaterThan(k,5), LessThanOrEqual(k,9)" in plan(op.lookup(stored, "k", low=5, high=9))
    assert op.lookup(stored, "k", low=5, high=9).count() == 4


def test_key_ranges_of_files_are_disjoint(stored):
    files = stored.groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:], strict=False))


@pytest.mark.parametrize(("strategy", "node"), [("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")])
def test_join_strategies(stored, strategy, node):
    assert node in plan(op.join(stored.alias("a"), stored.select("k", F.col("t").alias("u")), "k", strategy=strategy))


def test_products(stored):
    small = stored.where("k < 3").select(F.col("k").alias("j"))
    assert "BroadcastNestedLoopJoin" in plan(op.join(stored, small, F.col("k") < F.col("j"), strategy="broadcast"))
    assert "CartesianProduct" in plan(op.join(stored, small, F.col("k") < F.col("j"), strategy="product"))


def test_broadcast_is_checked(stored):
    assert "broadcast" not in plan(op.broadcast_if_small(stored, limit=1)).lower()


def test_range_join(spark):
    points = spark.createDataFrame([(x,) for x in (-7.5, 0.0, 3.0, 4.0, 9.99, 10.0, None)], "x double")
    bands = spark.createDataFrame([(1, -8.0, 3.0), (2, 3.0, 10.0), (3, 4.0, 4.0), (4, None, 5.0), (5, 9.0, 2.0)], "b int, lo double, hi double")
    joined = op.range_join(points, bands, "x", "lo", "hi", 2.5)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    assert sorted((r["x"], r["b"]) for r in joined.collect()) == [(-7.5, 1), (0.0, 1), (3.0, 2), (4.0, 2), (9.99, 2)]


def test_range_join_of_any_width(spark):
    rng = random.Random(1)
    points = [(float(k), rng.uniform(-1e4, 1e4)) for k in range(300)]
    bands = [(b, low, low + 10 ** rng.uniform(-3, 5)) for b in range(60) for low in [rng.uniform(-1e4, 1e4)]] + [(100, float("-inf"), float("inf")), (101, 0.0, float("inf")), (102, -1e300, 1e300)]
    joined = op.range_join(spark.createDataFrame(points, "k double, x double"), spark.createDataFrame(bands, "b int, lo double, hi double"), "x", "lo", "hi", 0.5)
    assert sorted((r["k"], r["b"]) for r in joined.collect()) == sorted((k, b) for k, x in points for b, lo, hi in bands if lo <= x < hi)
    assert joined.columns == ["k", "x", "b", "lo", "hi"]


def test_asof_join(spark):
    rng = random.Random(2)
    asked = [(k, rng.choice(["hot", "hot", "a", None, "z"]), rng.choice([None, rng.randrange(0, 1000)])) for k in range(400)] + [(1, "hot", 5)] * 2
    held = [(rng.choice(["hot", "hot", "a", None, "y"]), rng.choice([None, rng.randrange(100, 900)]), rng.randrange(50)) for _ in range(300)]
    want = []
    for k, key, t in asked:
        found = [(u, v) for g, u, v in held if key is not None and g == key and t is not None and u is not None and u <= t]
        want.append((k, key, t, *max(found, default=(None, None))))
    left, right = spark.createDataFrame(asked, "k long, key string, t long"), spark.createDataFrame(held, "key string, u long, v long")
    for parts in (1, 7, 64):
        out = op.asof_join(left, right, "key", "t", "u", parts)
        assert out.columns == ["k", "key", "t", "u", "v"]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert [tuple(r)[3:] for r in op.asof_join(left, right.limit(0), "key", "t", "u").collect()] == [(None, None)] * len(asked)


def test_top_needs_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(op.top(stored, 5, ("k", "desc")))


def test_changes_keep_pushdown(stored):
    text = plan(op.delete_overlay(stored, "g = 1").where("k = 5"))
    assert "EqualTo(k,5)" in text


def test_buckets_save_exchanges(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        a, b = columnar.store_bucketed(df, "bucketed_a", "k", 4), columnar.store_bucketed(df, "bucketed_b", "k", 4)
        joined = op.join(a, b.withColumnRenamed("g", "h"), "k", strategy="merge")
        assert "Exchange" not in plan(joined) and joined.count() == 2000
        assert "SelectedBucketsCount: 1 out of 4" in plan(a.where("k = 11"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("drop table if exists bucketed_a")
        spark.sql("drop table if exists bucketed_b")
