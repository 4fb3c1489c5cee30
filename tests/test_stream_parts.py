"""Many keys of a stream are swept in one call; messages are sorted natively."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wardline.operators import events as ve
from wardline.operators import search_index as si
from wardline.streaming import detect as sd
from tests.test_events_and_sources import failures, far, run_stream


def test_parts_hold_many_keys(spark, tmp_path):
    """Keys of one part stay apart, a null key among them; repeated rows count each."""
    both = failures(spark, [0, 5, 9, 20, 30, 200, 299, 300, 301, 700, 701], "a")
    for k, (name, at) in enumerate([("b", [0, 0, 0, 0, 0, 400, 800]), (None, [1, 2, 3, 4, 5, 6]), ("c", [9])], start=1):
        rows = failures(spark, at, "x").withColumn("user", F.lit(name).cast("string"))
        both = both.unionByName(rows.withColumn("event_id", F.col("event_id") + 100 * k))
    want = {r.event_id: r.failed_attempts for r in ve.brute_force(both.withColumn("user", F.coalesce("user", F.lit("-"))), ["user"]).collect()}
    pieces = [both.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
    got = run_stream(spark, pieces, lambda s: sd.stream_brute_force(s, "user", delay="20 minutes", parts=1), tmp_path, far(spark))
    assert {r.event_id: r.failed_attempts for r in got.collect()} == want and len({r.key for r in got.collect()}) >= 3


def test_sweep_in_steps_is_the_sweep_of_all():
    rng = np.random.default_rng(3)
    rows = sd.typed(pd.DataFrame({"key": rng.choice(["a", "b", "c"], 300), "us": np.sort(rng.integers(0, 500, 300)), "event_id": np.arange(300)}))
    nothing = sd.typed(pd.DataFrame({"key": [], "us": [], "n": []}))
    want = [((rows.key == r.key) & (rows.us <= r.us) & (rows.us >= r.us - 20)).sum() for r in rows.itertuples()]
    whole, _ = sd.sweep(nothing, rows, 20, 1)
    assert whole["failed_attempts"].tolist() == want
    seen, found = nothing, []
    for lo in range(0, 500, 50):
        out, seen = sd.sweep(seen, rows[(rows.us >= lo) & (rows.us < lo + 50)], 20, 5)
        found += zip(out["event_id"], out["failed_attempts"])
    assert sorted(found) == [(i, n) for i, n in enumerate(want) if n >= 5]


def test_index_sorts_words_without_a_lambda(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(si, "overwrite", lambda df, path, write=si.overwrite: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, path)))
    messages = spark.createDataFrame([(1, "b a B é a"), (2, None), (3, "")], "id long, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    si.index_messages(messages, str(tmp_path / "i"), "text", "ts", "id")
    rows = spark.read.parquet(str(tmp_path / "i" / si.POSTINGS)).where("word <> ''").collect()
    assert {(r.id, r.word, r.found, r.length) for r in rows} == {(1, "a", 2, 5), (1, "b", 2, 5), (1, "é", 1, 5)}
    assert "split(" in plans[0] and "array_sort(" not in plans[0] and "lambda left" not in plans[0]
    assert "split(" not in plans[1]  # messages are counted from what is stored, their words are not split again
    counts = {r.word: (r.n, r.words) for r in spark.read.parquet(str(tmp_path / "i" / si.COUNTS)).collect()}
    assert counts == {"": (3, 5), "a": (1, 2), "b": (1, 2), "é": (1, 1)}
