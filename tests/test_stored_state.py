"""Streams whose state is a table, and percentiles from stored sketches."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import events as ve
from wardline.operators import sketches as sk
from wardline.streaming import failures as fl

START = dt.datetime(2024, 1, 1)


def failed(spark, n, seed=5):
    """Half of all rows belong to one key, a part of them in one burst of equal times; a tenth has no key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 2 else (None if i % 10 == 0 else f"u{rng.randrange(40)}")
        rows.append((i, key, START + dt.timedelta(seconds=500 if i % 8 == 1 else rng.randrange(3600))))
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp")


def batches(df, n):
    """Batches of following times, with rows up to five minutes out of order."""
    moved = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(START)) + F.pmod(F.xxhash64("event_id"), F.lit(300))
    cut = df.withColumn("_b", F.least(F.floor(moved * n / 3900), F.lit(n - 1)))
    return [cut.where(F.col("_b") == i).drop("_b") for i in range(n)]


def closing(spark):
    return spark.createDataFrame([(10**6, "end", START + dt.timedelta(days=2))], "event_id long, key string, ts timestamp")


def as_set(df):
    return sorted((r.event_id, r.failed_attempts) for r in df.select("event_id", "failed_attempts").collect())


def test_table_state_equals_the_batch_query_with_a_hot_key(spark, tmp_path):
    df, path = failed(spark, 3000).cache(), str(tmp_path / "state")
    parts = [*batches(df, 4), closing(spark)]
    for i, part in enumerate(parts):
        fl.sweep(part, i, path, 60, 4, 600)
        if i == 2:  # delivered again, whole and after a half-written state
            fl.sweep(part, i, path, 60, 4, 600)
            spark.createDataFrame([], fl.ROWS).write.mode("overwrite").parquet(f"{path}/rows/side={i % 2}")
            fl.sweep(part, i, path, 60, 4, 600)
    got = as_set(spark.read.parquet(f"{path}/found"))
    assert got == as_set(ve.brute_force(df, ["key"], window_seconds=60, threshold=4)) and len(got) > 1000
    # The state after the last batch is the closing row alone: nothing older can matter.
    rows, mark = fl.version(spark, path, len(parts) - 1)
    assert [r.event_id for r in rows.collect()] == [10**6] and mark == START + dt.timedelta(days=2, seconds=-600)


def test_table_state_on_a_stream_with_blanks_and_late_rows(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    df = failed(spark, 200)
    blank = spark.createDataFrame([(7001, "hot", None), (None, "hot", START)], df.schema)
    late = spark.createDataFrame([(7002, "hot", START)], df.schema)
    for part in (df.unionByName(blank), closing(spark), late):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = fl.brute_force_table(stream, path, str(tmp_path / "ck"), "key", window_seconds=60, threshold=4)
    q.trigger(availableNow=True).start().awaitTermination()
    assert as_set(spark.read.parquet(f"{path}/found")) == as_set(ve.brute_force(df, ["key"], window_seconds=60, threshold=4))


def test_an_unfinished_batch_is_not_skipped(spark, tmp_path):
    with pytest.raises(ValueError):
        fl.sweep(failed(spark, 5), 3, str(tmp_path / "state"), 60, 4, 600)


def measured(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        op = ["hot", "hot", "cold", None][i % 4]
        v = {"hot": rng.lognormvariate(3, 2), "cold": rng.choice([0.0, 0.0, 5.0, 1e7])}.get(op, rng.random() * 1e-3)
        rows.append((op, START + dt.timedelta(minutes=rng.randrange(6000)), v))
    odd = [("hot", None, 1.0), ("hot", START, None), ("hot", START, math.nan), ("hot", START, -3.0), ("hot", START, math.inf)]
    return spark.createDataFrame(rows + odd, "op string, ts timestamp, ms double"), rows


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_sketches_hold_the_exact_percentiles_of_every_key(spark, tmp_path, error):
    df, rows = measured(spark)
    path = str(tmp_path / "sketches")
    sk.store_sketches(df, path, ["op"], "ts", "ms", error)
    start, end = START + dt.timedelta(hours=10), START + dt.timedelta(hours=80)
    for window, inside in (((None, None), rows), ((start, end), [r for r in rows if start <= r[1] < end])):
        got = {r.op: r for r in sk.sketch_percentiles(sk.read_sketches(spark, path, *window), ["op"], SHARES, error).collect()}
        assert set(got) == {"hot", "cold", None}
        for op, r in got.items():
            values = [v for o, _, v in inside if o == op]
            assert r.n == len(values) and r["avg"] == pytest.approx(np.mean(values))
            for name, q in SHARES.items():
                assert r[f"{name}_low"] <= np.quantile(values, q) <= r[f"{name}_high"]
                assert abs(r[name] - np.quantile(values, q)) <= error * np.quantile(values, q) + sk.SMALLEST


def test_sketches_merge_and_a_day_is_replaced(spark, tmp_path):
    df, _ = measured(spark)
    path = str(tmp_path / "sketches")
    whole = sk.sketch_percentiles(sk.sketch_table(df, ["op"], "ts", "ms"), ["op"], SHARES)
    sk.store_sketches(df, path, ["op"], "ts", "ms")
    sk.store_sketches(df.where("to_date(ts) = DATE'2024-01-02'"), path, ["op"], "ts", "ms")
    again = sk.sketch_percentiles(sk.read_sketches(spark, path), ["op"], SHARES)
    rounded = lambda d: sorted(((str(r.op), r.n, round(r["avg"], 6), r.p95) for r in d.collect()))
    assert rounded(whole) == rounded(again)
    halves = sk.sketch_table(df.where("ms < 10"), ["op"], "ts", "ms").unionByName(sk.sketch_table(df.where("ms >= 10"), ["op"], "ts", "ms"))
    assert rounded(sk.sketch_percentiles(halves, ["op"], SHARES)) == rounded(whole)


def test_sketches_read_only_their_days(spark, tmp_path):
    df, _ = measured(spark)
    path = str(tmp_path / "sketches")
    sk.store_sketches(df, path, ["op"], "ts", "ms")
    plan = sk.read_sketches(spark, path, START + dt.timedelta(days=1), START + dt.timedelta(days=2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan
    assert sk.sketch_percentiles(sk.read_sketches(spark, path, START + dt.timedelta(days=900)), ["op"], SHARES).count() == 0


def test_waiting_observations_lie_packed_in_the_state():
    """25 bytes each; as objects they took hundreds in Python."""
    from wardline.streaming import thresholds as st

    assert st.WAITING.itemsize == 25 and "waiting binary" in st.STATE
