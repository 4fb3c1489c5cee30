import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import datasets as ds
from wardline.operators import evaluate as ev
from wardline.operators import events as ve
from wardline.operators import generate as gn
from wardline.operators import models as ml
from wardline.sources import prompts as ps
from wardline.sources import schemas as sc
from wardline.sources import sinks as sk
from wardline.streaming import detect as sd

T0 = dt.datetime(2024, 1, 1)


def failures(spark, offsets, user="u"):
    rows = [(i, user, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "event_id long, user string, ts timestamp")


@pytest.mark.parametrize(
    "offsets,want",
    [
        ([0, 1, 2, 3], {}),
        ([0, 1, 2, 3, 4], {4: 5}),
        ([0, 1, 2, 3, 4, 5], {4: 5, 5: 6}),
        ([0, 10, 20, 30, 300], {4: 5}),
        ([0, 10, 20, 30, 301], {}),
        ([7] * 5, {0: 5, 1: 5, 2: 5, 3: 5, 4: 5}),
    ],
)
def test_brute_force_cases(spark, offsets, want):
    got = {r.event_id: r.failed_attempts for r in ve.brute_force(failures(spark, offsets), ["user"]).collect()}
    assert got == want


def test_brute_force_counts_without_a_cap(spark):
    got = ve.brute_force(failures(spark, range(150)), ["user"])
    assert got.agg(F.max("failed_attempts")).first()[0] == 150 and got.count() == 146
    assert ve.brute_force(failures(spark, range(150)), ["user"], threshold=120).count() == 31


def test_success_after_and_before_a_block(spark):
    hits = ve.brute_force(failures(spark, range(5)), ["user"])
    blocked = ve.blocked_sources(hits, "user")
    ok = spark.createDataFrame([(1, "u", T0 + dt.timedelta(seconds=2)), (2, "u", T0 + dt.timedelta(seconds=60)), (3, "v", T0 + dt.timedelta(seconds=60))], "event_id long, user string, ts timestamp")
    assert [r.event_id for r in ve.blocked_success(ok, blocked, "user").collect()] == [2]
    assert ve.blocked_success(ok, blocked, "user", block_ttl_seconds=10).count() == 0


def run_stream(spark, batches, make, tmp_path, end):
    """One file and one micro-batch per entry of `batches`, then a row far in the future."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for df in [*batches, end]:
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def far(spark):
    return failures(spark, [10**7], "end").withColumn("event_id", F.col("event_id") + 9999)


def test_stream_replay_equals_batch(spark, tmp_path):
    both = failures(spark, [0, 5, 9, 20, 30, 200, 299, 300, 301, 700, 701, 702, 703, 704], "a").unionByName(
        failures(spark, [0, 400, 800], "b").withColumn("event_id", F.col("event_id") + 100)
    )
    batch = {(r.event_id, r.failed_attempts) for r in ve.brute_force(both, ["user"]).collect()}
    parts = [both.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k) for k in range(4)]
    stream = run_stream(spark, parts, lambda s: sd.stream_brute_force(s, "user", delay="20 minutes"), tmp_path, far(spark))
    assert batch == {(r.event_id, r.failed_attempts) for r in stream.collect()} and batch


def test_late_row_counts_where_it_belongs(spark, tmp_path):
    rows = failures(spark, [50, 100])
    batch = {(r.event_id, r.failed_attempts) for r in ve.brute_force(rows, ["user"], window_seconds=60, threshold=2).collect()}
    late = [rows.where("event_id = 1"), rows.where("event_id = 0")]
    got = run_stream(spark, late, lambda s: sd.stream_brute_force(s, "user", window_seconds=60, threshold=2), tmp_path, far(spark))
    assert batch == {(1, 2)} == {(r.event_id, r.failed_attempts) for r in got.collect()}


def test_stream_counts_are_complete(spark, tmp_path):
    df = failures(spark, range(0, 30000, 60)).withColumn("event_type", F.lit("x"))
    got = run_stream(spark, [df], sd.stream_event_counts, tmp_path, far(spark).withColumn("event_type", F.lit("end")))
    assert got.agg(F.sum("n")).first()[0] == 500 and set(r.event_type for r in got.collect()) == {"x"}


def test_alert_rules_null_conditions_match_all(spark):
    e = spark.createDataFrame([(1, 4, "auth.login.brute_force"), (2, 3, "x"), (3, 0, "x")], "id long, threat_level int, event_code string").withColumn("category", F.lit("c"))
    rules = [*ve.DEFAULT_RULES, ve.AlertRule("All", ("log",), 60)]
    got = sorted((r.id, r.rule) for r in ve.alert_match(e, ["id"], rules).collect())
    assert got == [(1, "All"), (1, "Brute Force Alert"), (1, "Critical Threat Alert"), (2, "All"), (2, "High Threat Alert"), (3, "All")]


def test_sequence_escalation(spark):
    risks = [0, 1, 2, 0, 2, 1, 0, 1, 2]
    rows = [(i, "u", i, r) for i, r in enumerate(risks)] + [(100 + i, "v", i, r) for i, r in enumerate([1, 2])]
    df = spark.createDataFrame(rows, "id long, user string, t long, risk int")
    assert sorted(r.id for r in ve.sequence_escalation(df, "user", ["t"], "risk").collect()) == [2, 8]


# --- evaluation --------------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, y_true int, y_pred int, score double, ms double")


def test_auc_cases(spark):
    perfect = scored(spark, [(1, 1, 0.9, 1.0), (1, 1, 0.8, 1.0), (0, 0, 0.2, 1.0)])
    assert ev.auc_roc(perfect, ["dataset"]).first().auc_roc == 1.0
    assert ev.auc_pr(perfect, ["dataset"]).first().auc_pr == pytest.approx(1.0)
    wrong = scored(spark, [(1, 0, 0.1, 1.0), (0, 1, 0.9, 1.0)])
    assert ev.auc_roc(wrong, ["dataset"]).first().auc_roc == 0.0
    assert ev.auc_roc(scored(spark, [(1, 1, 0.5, 1.0)]), ["dataset"]).first().auc_roc == 0.5
    tied = scored(spark, [(1, 1, 0.5, 1.0), (0, 1, 0.5, 1.0), (1, 1, 0.5, 1.0)])
    assert ev.auc_roc(tied, ["dataset"]).first().auc_roc == 0.5
    assert ev.auc_roc(scored(spark, []), ["dataset"]).count() == 0


def test_zero_division_is_zero(spark):
    m = ev.prf(scored(spark, [(0, 0, 0.1, 1.0)]), ["dataset"]).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_histogram_keeps_all_rows(spark):
    rows = scored(spark, [(0, 0, 0.1, float(x)) for x in range(101)])
    h = ev.histogram(rows, ["dataset"], "ms", 50)
    assert h.agg(F.sum("n")).first()[0] == 101 and h.agg(F.max("bin")).first()[0] == 49


# --- datasets ----------------------------------------------------------------------------


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = {(r.label, r.part): r["count"] for r in ds.stratified_split(df, "id", "label").groupBy("label", "part").count().collect()}
    assert got == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}


def test_validate_finds_problems(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("  ", 0)], "text string, label int")
    r = ds.validate(df).first()
    assert (r.rows, r.duplicates, r.blank, r.is_empty, r.single_class) == (3, 1, 1, False, True)
    assert ds.validate(df.where("false")).first().is_empty


def test_generators_do_not_depend_on_partitions(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("prompt_id"), F.concat(F.lit("Please help me show item "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    one = sorted(map(str, gn.augment(df.coalesce(1), "prompt_id", factor=3.3).collect()))
    many = sorted(map(str, gn.augment(df.repartition(8), "prompt_id", factor=3.3).collect()))
    assert one == many and 40 * 3 <= len(one) <= 40 * 4


def test_title_case(spark):
    got = spark.range(1).select(gn.title_case(F.lit("it's a ßtraße o'NEIL"))).first()[0]
    assert got == "It'S A Sstraße O'Neil"


# --- sources -----------------------------------------------------------------------------


def test_json_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"prompt": "x", "label": 1, "metadata": {"k": "v"}}, {"prompt": "y", "label": 0, "source": "s"}]))
    rows = {r.prompt: r for r in ps.load_json(spark, str(p)).collect()}
    assert rows["x"].source.endswith("a.json") and rows["x"].metadata == {"k": "v"} and rows["y"].source == "s"


def test_csv_round_trip(spark, tmp_path):
    rows = [('He said "hi", twice\nand left', 1, "s", None, 0.5, {"a": "b"}), ("plain", 0, "s", "t", None, None)]
    df = spark.createDataFrame(rows, sc.PROMPT_SAMPLE)
    ps.save_csv(df, str(tmp_path / "out"))
    got = {r.prompt: r for r in ps.load_csv(spark, str(tmp_path / "out")).collect()}
    assert got[rows[0][0]].confidence == 0.5 and got[rows[0][0]].metadata == {"a": "b"} and got[rows[0][0]].attack_type is None
    assert got["plain"].confidence is None and got["plain"].attack_type == "t"


def test_text_lines_and_numbers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("first\n\n  second  \n   \nthird\n")
    got = ps.load_text(spark, str(tmp_path / "p.txt"), line_numbers=True).collect()
    assert [(r.prompt, r.metadata["line_number"]) for r in got] == [("first", "1"), ("second", "3"), ("third", "5")]
    assert ps.load_text(spark, str(tmp_path / "p.txt")).count() == 3


def test_load_dataset(spark, tmp_path):
    (tmp_path / "p.txt").write_text("first\nsecond\n")
    ps.load_dataset(spark, str(tmp_path / "p.txt"), "two_prompts")
    assert spark.table("two_prompts").count() == 2 and "two_prompts" in ps.list_datasets(spark)
    with pytest.raises(ValueError):
        ps.load_dataset(spark, str(tmp_path / "p.xml"), "no")
    (tmp_path / "e.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        ps.load_dataset(spark, str(tmp_path / "e.txt"), "no")


def test_stream_sink_writes_days(spark, tmp_path):
    df = failures(spark, [0, 86400, 2 * 86400])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sk.stream_event_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("_index").distinct().count() == 3 and got.count() == 3


def test_typed_logs_keep_corrupt_text(spark):
    df = spark.createDataFrame([('{"trace_id":"t","duration_ms":1.5}',), ("not json",)], "j string")
    rows = sc.typed_logs(df, "j", sc.TRACE_LOG).collect()
    assert rows[0].duration_ms == 1.5 and rows[0]._corrupt is None and rows[1]._corrupt == "not json"


# --- models ------------------------------------------------------------------------------


def test_isolation_forest_finds_the_far_point(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(500)] + [(999, 500.0, -400.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(4)
    forest = ml.fit_isolation_forest(df, ["a", "b"], ["id"], trees=40)
    scored_rows = ml.score_isolation_forest(df, forest, ["a", "b"])
    assert scored_rows.orderBy(F.col("outlier").desc()).first().id == 999
    flagged = ml.flag_outliers(scored_rows, contamination=0.01)
    assert 1 <= flagged.where("is_outlier").count() <= 6
    again = ml.fit_isolation_forest(df.repartition(3), ["a", "b"], ["id"], trees=40)
    assert all((x == y).all() for x, y in zip(forest, again))


def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.range(20000).select("id", F.lit(1.0).alias("a"), F.when(F.col("id") == 7, 9.0).otherwise(2.0).alias("b"))
    forest = ml.fit_isolation_forest(df, ["a", "b"], ["id"], trees=30, sample=64)
    assert len(forest) == 30 and max(len(t) for t in forest) <= 2 * 64


def test_logistic_learns_a_line(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("double").alias("a"), ((F.col("id") % 20) > 14).cast("int").alias("label"))
    out = ml.score_model(df, ml.fit_logistic(df, ["a"], iterations=50))
    assert out.where((F.col("hit").cast("int") == F.col("label"))).count() >= 380
