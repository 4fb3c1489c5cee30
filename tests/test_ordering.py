"""The skew-safe ordered helpers against plain loops; one key holds most of the rows and times repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import ordering as od


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        out.append((i, key, rng.randrange(0, 2000), rng.choice([0.5, 1.25, -3.0, 7.0, rng.random() * 100])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, t long, v double").repartition(8)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_index(df, rows):
    got = {r.id: r.idx for r in od.running_index(df, ["key"], ["t", "id"]).collect()}
    want = {r[0]: i for part in by_key(rows).values() for i, r in enumerate(part)}
    assert got == want


@pytest.mark.parametrize("block", [16, 100, 100000])
@pytest.mark.parametrize("skip", [False, True])
def test_rolling_sum(df, rows, block, skip):
    indexed = od.running_index(df, ["key"], ["t", "id"])
    rolled = od.rolling_sum(indexed, ["key"], "idx", F.col("id"), 10, "s", skip_current=skip, block=block)
    got = {r.id: r.s for r in rolled.collect()}
    want = {}
    for part in by_key(rows).values():
        ids = [r[0] for r in part]
        for i, r in enumerate(part):
            end = i if skip else i + 1
            want[r[0]] = sum(ids[max(0, end - 10) : end])
    assert got == want


def test_lag(df, rows):
    indexed = od.running_index(df, ["key"], ["t", "id"])
    got = {r.id: (r.p1, r.p2) for r in od.lag_by_index(indexed, ["key"], "idx", {"p1": ("id", 1), "p2": ("id", 2)}, block=7).collect()}
    for part in by_key(rows).values():
        ids = [None, None] + [r[0] for r in part]
        for i, r in enumerate(part):
            assert got[r[0]] == (ids[i + 1], ids[i])


@pytest.mark.parametrize("window", [1, 5, 300, 5000])
def test_trailing_count(df, rows, window):
    got = {r.id: r.n for r in od.trailing_count(df, ["key"], "t", window, "n").collect()}
    for r in rows:
        assert got[r[0]] == sum(1 for o in rows if o[1] == r[1] and r[2] - window <= o[2] <= r[2])


def test_exact_percentiles(df, rows):
    got = {r.key: r for r in od.exact_percentiles(df, ["key"], F.col("v"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    for key in {r[1] for r in rows}:
        values = [r[3] for r in rows if r[1] == key]
        for name, p in (("p05", 5), ("p50", 50), ("p95", 95)):
            assert got[key][name] == pytest.approx(np.percentile(values, p))
    whole = od.exact_percentiles(df, [], F.col("v"), {"p": 0.9}).first()["p"]
    assert whole == pytest.approx(np.percentile([r[3] for r in rows], 90))


@pytest.mark.parametrize("what", ["one second", "one day", "one value range"])
def test_ranges_stay_bounded(spark, what):
    """All rows of one key, close together: no range holds much more than its share."""
    n = 20_000
    t = {"one second": F.lit(5), "one day": F.col("id") % 86400, "one value range": 0.5 + F.col("id") / 1e9}[what]
    df = spark.range(n).select("id", F.lit("k").alias("key"), t.alias("t"))
    sizes = [r["count"] for r in od.parted(df, ["key"], ["t", "id"]).groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 2 * n / int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = od.running_index(df, ["key"], ["t", "id"]).agg(F.max("idx"), F.count_distinct("idx")).first()
    assert tuple(last) == (n - 1, n)


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, key string")
    assert {r.id: r.idx for r in od.running_index(df, ["key"], ["id"]).collect()} == {1: 0, 2: 1, 3: 0}


def test_latest_per_key(df, rows):
    got = {r.key: r.id for r in od.latest_per_key(df, ["key"], ["t", "id"]).collect()}
    assert got == {k: part[-1][0] for k, part in by_key(rows).items()}
