"""Shared helpers."""

import random

import numpy as np
import pyarrow as pa

from millrace.llm import common


def test_fresh_names_clash_with_none():
    assert common.fresh(["a", "Score", "_score"], "score", "a", "b", "B") == ["__score", "_a", "b", "_B"]


def test_a_worker_holds_one_state():
    made = []
    for key in ("a", "a", "b", "a"):
        assert common.worker_state(key, lambda key=key: made.append(key) or key) == key
        assert list(common._STATE) == [key]
    assert made == ["a", "b", "a"]
    common._STATE.clear()


def test_trimmed_passes_batches_on():
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(common.trimmed(iter)(batches)) == batches


def test_ranges():
    assert common.ranges(np.array([5, 0, 7]), np.array([2, 0, 3])).tolist() == [5, 6, 7, 8, 9]


def test_sums_before(spark):
    rng = random.Random(1)
    rows = sorted(((k if k % 9 else None, f"s{k % 13}" if k % 7 else None, rng.randrange(50), k) for k in range(500)), key=lambda r: (r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0, r[3]))
    df = spark.createDataFrame(rows, "a long, s string, n long, k long").repartition(7)
    want, total = {}, 0
    for r in rows:
        want[r[3]] = total
        total += r[2]
    for on in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", on)
        try:
            got = {r["k"]: r["before"] for r in common.with_sums_before(df, "t", "n", "s", "a", "k").collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want
    assert common.with_sums_before(df.limit(0), "t", "n", "s", "a", "k").collect() == []


def test_small_inputs_are_spread(spark):
    few = spark.range(10).coalesce(1)
    assert few.count() == common.spread(few).count() == 10
    assert "RoundRobinPartitioning" in common.spread(few)._jdf.queryExecution().executedPlan().toString()
    large = spark.range(1 << 40)
    assert "RoundRobinPartitioning" not in common.spread(large)._jdf.queryExecution().executedPlan().toString()


def test_batches_are_set_where_the_session_is_silent(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "77")
    try:
        common.prepare(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
    common.prepare(spark)
    assert spark.conf.get(key) == common.BATCHES[key]
