"""Python plug-ins, ranked search and records with undeclared fields, against plain loops."""

import datetime as dt
import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import plugins as pg
from wardline.operators import search_index as si
from wardline.sources import schemas as sc


def test_one_failing_row_leaves_the_others_scored(spark):
    def plugin(rows):
        if (rows["n"] == 613).any():
            raise KeyError("six hundred")
        return rows["n"] * 2.0

    df = spark.range(2000).select(F.col("id").alias("n")).coalesce(1)
    got = {r.n: r.plugins.twice for r in pg.python_plugins(df, {"twice": plugin}, ["n"]).collect()}
    assert got[613].result is None and got[613].error == "KeyError: 'six hundred'"
    assert all(got[n].result == 2.0 * n and got[n].error is None for n in range(2000) if n != 613)


def test_a_failing_row_costs_few_calls():
    calls = []

    def plugin(rows):
        calls.append(len(rows))
        if (rows["n"] == 700).any():
            raise ValueError
        return rows["n"]

    out = pg.isolated(plugin, pd.DataFrame({"n": range(1024)}))
    assert [i for i, (r, _) in enumerate(out) if r is None] == [700] and len(calls) <= 21
    assert pg.isolated(plugin, pd.DataFrame({"n": []})) == []


def test_plugins_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, text string")
    plugins = {
        "short": lambda rows: [1.0] * (len(rows) + 1),
        "none": lambda rows: [None] * len(rows),
        "length": lambda rows: [len(t) for t in rows["text"]],
        "word": lambda rows: ["many"] * len(rows),
    }
    got = pg.python_plugins(df, plugins, ["text"]).orderBy("id").collect()
    assert len(got) == 3 and {r.plugins.none.error for r in got} == {"no result"}
    assert {r.plugins.short.error for r in got} == {"ValueError: 2 results for 1 rows"}
    assert got[0].plugins.length.result == 1.0 and got[1].plugins.length.error.startswith("TypeError")
    assert all(r.plugins.word.error.startswith("ValueError") for r in got)
    assert pg.python_plugins(df.limit(0), plugins, ["text"]).count() == 0
    assert pg.python_plugins(df, {}, ["text"]).columns == df.columns


def plain_search(rows, query, limit):
    """rows: (id, text) of the days in the range."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    texts = {i: split(t) for i, t in rows}
    average = sum(map(len, texts.values())) / len(texts)
    scores = {}
    for w in set(split(query)):
        n = sum(w in t for t in texts.values())
        for i, t in texts.items():
            if w in t:
                found, idf = t.count(w), math.log(1 + (len(texts) - n + 0.5) / (n + 0.5))
                scores[i] = scores.get(i, 0.0) + idf * found * 2.2 / (found + 1.2 * (0.25 + 0.75 * len(t) / average))
    return sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:limit]


def messages(spark, rows):
    stamped = [(i, dt.datetime(2024, 1, d, 5), t) for i, d, t in rows]
    return spark.createDataFrame(stamped, "id long, ts timestamp, text string")


ROWS = [(i, 1 + i % 4, " ".join(["login"] * (i % 3) + ["failed"] * (i % 5 == 0) + [f"user{i % 7}"] + ["x"] * (i % 11))) for i in range(120)] + [(500, 2, None), (501, 2, "")]


def test_search_equals_a_plain_score(spark, tmp_path):
    path = str(tmp_path / "index")
    si.index_messages(messages(spark, ROWS), path, "text", "ts", "id")
    got = [(r.score, r.id) for r in si.search(spark, path, "Failed LOGIN, user3!", limit=20).collect()]
    assert got == plain_search([(i, t) for i, _, t in ROWS], "failed login user3", 20)
    some = si.search(spark, path, "failed login", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4)).collect()
    assert [(r.score, r.id) for r in some] == plain_search([(i, t) for i, d, t in ROWS if d in (2, 3)], "failed login", 100)
    assert si.search(spark, path, "...").count() == 0 and si.search(spark, path, "nobody").count() == 0


def test_a_search_reads_only_its_days_and_words(spark, tmp_path):
    path = str(tmp_path / "index")
    si.index_messages(messages(spark, ROWS), path, "text", "ts", "id")
    plan = si.search(spark, path, "failed", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day[^\]]*2024-01-02", plan) and re.search(r"PushedFilters: \[[^\]]*word[^\]]*failed", plan)
    assert spark.read.parquet(f"{path}/{si.POSTINGS}").where("word = 'failed'").count() == sum("failed" in (t or "").split() for _, _, t in ROWS)


def test_a_day_indexed_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    df = messages(spark, ROWS)
    si.index_messages(df, path, "text", "ts", "id")
    before = si.search(spark, path, "failed login").collect()
    si.index_messages(df.where("day(ts) = 2"), path, "text", "ts", "id")
    assert si.search(spark, path, "failed login").collect() == before
    si.index_messages(df.where("day(ts) = 2").withColumn("text", F.lit(None).cast("string")), path, "text", "ts", "id")
    rest = [(i, None if d == 2 else t) for i, d, t in ROWS]
    assert [(r.score, r.id) for r in si.search(spark, path, "failed login").collect()] == plain_search(rest, "failed login", 100)


def test_variant_logs(spark):
    rows = [(1, '{"a": 7, "b": {"c": [1, "x"]}}'), (2, '{"a": "8"}'), (3, '{"a": {"z": 1}}'), (4, "{oops"), (5, None), (6, "[]")]
    df = spark.createDataFrame(rows, "id long, j string")
    t = sc.variant_logs(df, "j", {"a": ("$.a", "bigint"), "c1": ("$.b.c[1]", "string")})
    got = {r.id: (r.a, r.c1, r[sc.CORRUPT]) for r in t.drop("raw_data").collect()}
    assert got == {1: (7, "x", None), 2: (8, None, None), 3: (None, None, None), 4: (None, None, "{oops"), 5: (None, None, None), 6: (None, None, None)}
    schemas = {r.kind: (r.schema, r.n) for r in sc.variant_schemas(t.where("id <= 4").withColumn("kind", F.col("id") <= 1), ["kind"]).collect()}
    assert schemas[False] == ("OBJECT<a: VARIANT>", 2) and schemas[True][1] == 1


@pytest.mark.parametrize("missing", ["xxhash", "wardline.llm.queries"])
def test_the_entry_stands_without_the_optional_part(missing, monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("wardline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="not registered"):
        names = set(entry.queries())
    assert "prompt_risk" in names and "op3_byte_bpe" not in names
