"""Decisions with feedback and thresholds on a stream, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import feedback as fb
from wardline.operators import fusion as fu
from wardline.streaming import thresholds as st


def plain_feedback(rows, bar, last=100, minimum=10):
    """rows: (id, weight) of one key in order; anomalous where weight + rate / 2 is over the bar."""
    seen, out = [], {}
    for i, (id_, weight) in enumerate(rows):
        rate = sum(seen[-last:]) / min(i, last) if i >= minimum else 0.0
        seen.append(weight + rate / 2 > bar)
        out[id_] = (rate, seen[-1])
    return out


def feed(spark, weights, bar, key=lambda i: "a", block=100, rising=True, **kw):
    rows = [(i, key(i), float(w)) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "id long, key string, weight double").repartition(5)
    got = fb.feedback_decisions(df, ["key"], ["id"], lambda rate: F.col("weight") + rate / 2 > bar, rising, block=block, **kw).collect()
    want = {}
    for k in {r[1] for r in rows}:
        want |= plain_feedback([(i, w) for i, kk, w in rows if kk == k], bar, **kw)
    assert len(got) == len(rows)
    assert {r.id: (r.recent_rate, r.is_anomalous) for r in got} == want
    return want


def test_feedback_equals_a_plain_loop_with_a_hot_and_a_null_key(spark):
    rng = random.Random(1)
    weights = [rng.random() for _ in range(1500)]
    want = feed(spark, weights, 0.7, key=lambda i: "hot" if i % 3 else (None if i % 2 else "cold"))
    assert len({w[1] for w in want.values()}) == 2


def test_feedback_that_never_forgets_needs_its_start(spark):
    """All rows hang on the rate: ten early hits keep the rest going, or the rest stays normal without them."""
    early = [1.0] * 10 + [0.0] * 290
    want = feed(spark, early, 0.04, last=20, minimum=5, block=50)
    assert want[299] == (1.0, True)
    assert feed(spark, [0.0] * 300, 0.04, last=20, minimum=5, block=50)[299] == (0.0, False)


def test_feedback_of_a_verdict_that_falls_again(spark):
    rows = [(i, float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, w double")
    verdict = lambda rate: (F.abs(rate - 0.5) * 10 < F.col("w")) & (F.col("w") < 6) | (F.col("w") == 6)
    got = {r.id: r.is_anomalous for r in fb.feedback_decisions(df, [], ["id"], verdict, last=30, block=64).collect()}
    seen = []
    for i, w in rows:
        rate = sum(seen[-30:]) / min(i, 30) if i >= 10 else 0.0
        seen.append(abs(rate - 0.5) * 10 < w < 6 or w == 6)
    assert [got[i] for i in range(400)] == seen and 0 < sum(seen) < 400


def test_feedback_edges(spark):
    df = spark.createDataFrame([], "id long, key string, weight double")
    assert fb.feedback_decisions(df, ["key"], ["id"], lambda rate: F.col("weight") > rate).count() == 0
    one = spark.createDataFrame([(1, "a", None), (2, "a", 5.0)], "id long, key string, weight double")
    got = fb.feedback_decisions(one, ["key"], ["id"], lambda rate: F.col("weight") > rate).orderBy("id").collect()
    assert [r.is_anomalous for r in got] == [False, True]
    with pytest.raises(ValueError):
        fb.feedback_decisions(one, ["key"], ["id"], lambda rate: F.col("weight") > rate, block=99)


def test_a_missing_signal_is_normal(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "a b", 1.0)], "id long, text string, x double")
    config = fu.FusionConfig(default_threshold=fu.ThresholdConfig(context_weight=1.0))
    signals = {"embedding_distance": F.col("x"), "token_frequency": F.lit(1.0)}
    got = fb.detect_with_feedback(df, [], ["id"], signals, config).orderBy("id").collect()
    assert [r.is_anomalous for r in got] == [False, True]


def observations(spark, n, seed):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", None]), start + dt.timedelta(seconds=i // 3), rng.random(), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp, score double, label boolean")


def run_stream(spark, parts, end, make, folder):
    src = str(folder / "in")
    for part in [*parts, end]:
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def test_stream_thresholds_equal_the_batch_query(spark, tmp_path):
    config = fu.ThresholdConfig(window=60)
    df = observations(spark, 900, 3)
    blank = spark.createDataFrame([(9001, "a", None, 0.5, True), (9002, "a", dt.datetime(2024, 1, 1), None, True), (9003, "a", dt.datetime(2024, 1, 1), 0.5, None)], df.schema)
    end = df.limit(1).select(F.lit(9999).cast("long").alias("event_id"), F.lit("end").alias("key"), (F.col("ts") + F.expr("INTERVAL 9 DAY")).alias("ts"), "score", "label")
    parts = [(df.unionByName(blank) if i == 0 else df).where((F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) | (F.col("event_id") > 9000)) for i in range(3)]
    got = run_stream(spark, parts, end, lambda s: st.stream_thresholds(s, "key", "score", "label", config=config, delay="10 minutes"), tmp_path)
    newest = {r.key: (r.n, round(r.t, 9)) for r in got.where("key IS DISTINCT FROM 'end'").groupBy("key").agg(F.max("n").alias("n"), F.max_by("threshold", "n").alias("t")).collect()}
    want = {r.key: (r.n, round(r.threshold, 9)) for r in fu.adapt_thresholds(df, ["key"], ["ts", "event_id"], "score", "label", config).collect()}
    assert newest == want and set(want) == {"a", None}


def test_observations_are_packed_by_key():
    """One row per key of a step, whatever their order; what lacks a part only tells its time."""
    import numpy as np
    import pyarrow as pa

    rows = [("a", 5, 1, 0.5, True), (None, 7, 2, 0.25, False), ("a", 9, 3, None, True), ("a", 3, 4, 0.75, False), ("b", None, 5, 0.5, True), ("b", None, 6, 0.5, True), ("c", 2, None, 0.1, True), ("a", 1, 8, float("nan"), True)]
    kinds = pa.schema([("key", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("label", pa.bool_())])
    whole = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)
    (got,) = st.packs(iter([whole.slice(0, 3), whole.slice(3), whole.slice(0, 0)]))
    found = {r["key"]: (r["us"], np.frombuffer(r["packed"], st.WAITING).tolist()) for r in got.to_pylist()}
    assert found == {"a": (9, [(5, 1, 0.5, True), (3, 4, 0.75, False)]), None: (7, [(7, 2, 0.25, False)]), "b": (None, []), "c": (2, [])}
    many = pa.RecordBatch.from_pylist([dict(zip(kinds.names, ("ab"[i % 2], i, i, 0.5, True))) for i in range(3000)], kinds)
    assert [b.num_rows for b in st.packs(iter([many.slice(at, 1000) for at in range(0, 3000, 1000)]))] == [2]
    assert list(st.packs(iter([]))) == []


def test_a_key_meets_its_state_once_a_trigger(spark, tmp_path, monkeypatch):
    """4000 rows of a key are handed over with its state once, not once for 1024 of them; a row later than `delay` is left out."""
    df = observations(spark, 4000, 5).withColumn("key", F.lit("a"))
    start = dt.datetime(2024, 1, 1)
    end = df.limit(1).select(F.lit(9999).cast("long").alias("event_id"), F.lit("end").alias("key"), (F.col("ts") + F.expr("INTERVAL 9 DAY")).alias("ts"), "score", "label")
    late = spark.createDataFrame([(9001, "a", start, 0.5, True), (9002, "end", start + dt.timedelta(days=20), 0.5, True)], df.schema)
    plans = []

    def make(s):
        out = st.stream_thresholds(s, "key", "score", "label", delay="10 minutes")
        plans.append(out._jdf.queryExecution().logical().toString())
        return out

    got = run_stream(spark, [df, end, end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))], late, make, tmp_path)
    (want,) = fu.adapt_thresholds(df, ["key"], ["ts", "event_id"], "score", "label").collect()
    newest = got.where("key = 'a'").groupBy("key").agg(F.max("n").alias("n"), F.max_by("threshold", "n").alias("t")).first()
    assert (newest.n, round(newest.t, 9)) == (4000, round(want.threshold, 9))
    assert plans[0].index("FlatMapGroupsInPandasWithState") < plans[0].index("MapInArrow")
