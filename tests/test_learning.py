"""Networks with own losses, models that learn from a stream, the vector index, and the quality of the model queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import similarity as sm
from wardline.operators import trainer as tr
from wardline.operators import vector_index as vi
from wardline.plans import model_queries as mq
from wardline.plans import similarity_queries as sq
from wardline.plans import source_queries as so
from wardline.streaming import learn as sl

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("loss", [tr.CROSS_ENTROPY, tr.Loss(), tr.Loss(1.0, 0.0), tr.Loss(0.0, 1.0, 7.0)])
def test_gradient_is_the_slope_of_the_loss(loss):
    rng = np.random.default_rng(1)
    sizes, x, y, w = [4, 6, 3, 1], rng.normal(size=(30, 4)), (rng.random(30) > 0.5).astype(float), rng.integers(0, 3, 30).astype(float)
    theta = 0.7 * rng.normal(size=len(tr.start(sizes, 5)))
    p, _ = tr.forward(theta, sizes, x)
    assert abs(p - 0.5).min() > 1e-4  # no row changes its weight within the small steps below
    value, slope = tr.gradient(theta, sizes, x, y, w, loss)
    for i in range(0, len(theta), 3):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        high, low = (tr.gradient(theta + s, sizes, x, y, w, loss)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-6)
    assert value == pytest.approx(sum(w * loss.of(p, y)[0]))


def rings(spark, n=600):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2)) * 1.5
    rows = [(i, float(a), float(b), int(a * a + b * b > 2.5)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(3)


def test_steps_in_tasks_equal_one_loop(spark):
    """Gradient sums of all tasks, added in two levels, are those of all rows together."""
    df = rings(spark).select(F.col("id").cast("string").alias("key"), F.col("label").cast("double").alias("y"), F.array("a", "b").alias("x"), F.array(F.lit(1.0), F.col("id") % 3 * 1.0).alias("w"), (F.col("id") % 5 == 0).alias("valid"))
    sizes, losses = [2, 8, 1], [tr.Loss(), tr.CROSS_ENTROPY]
    thetas = [tr.start(sizes, 1), tr.start(sizes, 2)]
    rows = df.toPandas()
    x, y, held = np.stack(rows.x.to_numpy()), rows.y.to_numpy(), rows.valid.to_numpy()
    for parts in (df, df.repartition(3 * tr.FAN)):
        for k, s in enumerate(tr.step_sums(parts, sizes, thetas, losses, ("s", 1, 0), True)):
            w = np.stack(rows.w.to_numpy())[:, k]
            assert np.allclose(s["grad"], tr.gradient(thetas[k], sizes, x[~held], y[~held], w[~held], losses[k])[1])
            assert s["n"] == w[~held].sum() and s["n_checked"] == held.sum()
            assert s["checked"] == pytest.approx(losses[k].of(tr.forward(thetas[k], sizes, x[held])[0], y[held])[0].sum())


def test_networks_learn_and_stop(spark):
    df = rings(spark)
    fitted = tr.fit_networks(df, "id", ["a", "b"], losses=[tr.CROSS_ENTROPY] * 2, hidden=(16,), epochs=60, batches=2, rate=0.05, patience=3)
    again = tr.fit_networks(df.repartition(5), "id", ["a", "b"], losses=[tr.CROSS_ENTROPY] * 2, hidden=(16,), epochs=60, batches=2, rate=0.05, patience=3)
    assert all(np.allclose(a, b) for a, b in zip(fitted.thetas, again.thetas))
    assert len(fitted.history) < 60 and min(h[0] for h in fitted.history) < 0.5 * fitted.history[0][0]
    scored = tr.score_networks(df, fitted, ["a", "b"])
    right = scored.select(F.avg((F.col("votes")[0] == F.col("label")).cast("int"))).first()[0]
    assert right > 0.93
    none = tr.score_networks(df, tr.fit_networks(df.where("false"), "id", ["a", "b"]), ["a", "b"]).first()
    assert none.probabilities == [0.5] * 5
    odd = tr.score_networks(spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double"), fitted, ["a", "b"]).collect()
    assert all(0 <= p <= 1 for r in odd for p in r.probabilities)


def test_more_weight_on_misses_means_fewer_of_them(spark):
    got = {(r.miss_weight, r.part): r for r in mq.miss_weighted_training(spark, MEDIUM).collect()}
    light, heavy = min(mq.MISS_WEIGHTS), max(mq.MISS_WEIGHTS)
    both = lambda w, c: sum(got[w, p][c] for p in ("train", "test"))
    assert both(light, "missed") > 0 and both(heavy, "missed") < both(light, "missed")
    assert got[heavy, "test"].missed <= got[light, "test"].missed and both(heavy, "false_alarms") >= both(light, "false_alarms")


# --- streams ---------------------------------------------------------------------------------------


def test_online_steps_equal_a_loop_and_survive_a_second_delivery(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), None if i % 17 == 0 else int(a > b)) for i, (a, b) in enumerate(rng.normal(3, 2, size=(200, 2)))]
    centers, source = {"a": (3.0, 2.0), "b": (3.0, 2.0)}, str(tmp_path / "rows")
    schema = "id long, a double, b double, label int"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(source)
    path = str(tmp_path / "versions")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = sl.online_steps(stream, path, str(tmp_path / "checkpoint"), ["a", "b"], "label", centers, 0.7, 2)
    writer.trigger(availableNow=True).start().awaitTermination()
    versions = {r.batch: r for r in spark.read.schema(sl.VERSION + ", batch long").parquet(path).collect()}
    assert sorted(versions) == [-1, 0, 1, 2, 3]
    w, left = np.zeros(3), [rows[50 * k : 50 * k + 50] for k in range(4)]
    for k in range(4):
        # Files of equal age may come in any order: the batch whose first step fits is the one that was delivered.
        for j, part in enumerate(left):
            x = np.array([[(r[1] - 3) / 2, (r[2] - 3) / 2, 1.0] for r in part if r[3] is not None])
            y, now = np.array([r[3] for r in part if r[3] is not None], float), w.copy()
            for _ in range(2):
                now = now - 0.7 * x.T @ (1 / (1 + np.exp(-x @ now)) - y) / len(y)
            if np.allclose(now, versions[k].weights):
                w, _ = now, left.pop(j)
                break
        else:
            pytest.fail(f"no batch makes version {k}")
    assert not left and list(sl.version(spark, path)["weights"]) == versions[3].weights
    # A batch that is delivered again starts from the version before it: nothing changes.
    for _ in range(2):
        sl.take(spark.createDataFrame(part, schema).repartition(4), 3, path, ["a", "b"], "label", centers, 0.7, 2)
        again = {r.batch: r for r in spark.read.schema(sl.VERSION + ", batch long").parquet(path).collect()}
        assert sorted(again) == sorted(versions) and all(np.allclose(again[k].weights, versions[k].weights) for k in versions)
    sl.take(spark.createDataFrame(part, schema).where("label is null"), 4, path, ["a", "b"], "label", centers, 0.7, 2)
    assert np.allclose(sl.version(spark, path)["weights"], versions[3].weights) and sl.version(spark, path)["rows"] == 0


# --- vector index ------------------------------------------------------------------------------------


def test_index_finds_nine_tenths_at_a_tenth_of_the_vectors(spark):
    got = sq.knn_recall(spark, "/root/testdata/sf0.1").toPandas()
    assert got.found.sum() >= 0.9 * got.wanted.sum() and got.read_share.max() <= 0.1 and got.off.max() == 0


def test_index_of_clustered_vectors_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(30, 16))
    v = middle[rng.integers(30, size=2000)] + 0.25 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(v)] + [(9999, None, "clash")], "id long, v array<double>, cell string")
    index = vi.build(df, "id", "v", str(tmp_path / "index"), parts=8)
    assert len(index.centers) == 44 and index.vectors(spark).count() == 2000
    assert index.codes(spark).select(F.sum(F.size("ids"))).first()[0] == 2000
    ask = df.where("id % 20 = 0")
    exact = {(r.query_id, r.corpus_id) for r in sm.knn_search(ask, df.where("v is not null"), "id", "v", 5, -1.0).collect()}
    found = vi.search(index, ask, "id", "v", 5, probes=6, rerank=100).collect()
    assert len(exact & {(r.query_id, r.corpus_id) for r in found}) >= 0.9 * len(exact) and max(r.n_read for r in found) <= 100
    plan = index.vectors(spark).where("part = 1").inputFiles()
    assert all("part=" in f for f in plan)


def test_search_reads_a_bounded_number_and_shuffles_hits_only(spark, tmp_path, monkeypatch):
    """The candidates of a query never leave their block: k hits and a count a block, whatever is read."""
    monkeypatch.setattr(vi.blocks_of, "__defaults__", (500,))
    met, plain = [], vi.meet
    monkeypatch.setattr(vi, "meet", lambda *a: met.append(plain(*a)) or met[-1])
    v = np.random.default_rng(8).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    index = vi.build(df, "id", "v", str(tmp_path / "index"), parts=4)
    assert index.vectors(spark).schema["v"].dataType.simpleString() == "array<float>"
    ask = df.where("id % 20 = 0")
    found = vi.search(index, ask, "id", "v", 5, len(index.centers), 100).collect()
    exact = {(r.query_id, r.corpus_id) for r in sm.knn_search(ask, df, "id", "v", 5, -1.0).collect()}
    assert len(exact & {(r.query_id, r.corpus_id) for r in found}) >= 0.9 * len(exact) and len(found) == 500
    assert {r.n_read for r in found} == {400} and met[0].count() == 100 * 4 * (5 + 1)


# --- what the queries decide ---------------------------------------------------------------------------


def right(df, hit="hit"):
    return df.select(F.avg((F.col(hit).cast("int") == F.col("label")).cast("int"))).first()[0]


@pytest.mark.parametrize("query,hit,least", [(mq.fit_logistic, "hit", 0.6), (mq.random_forest, "hit", 0.9), (mq.mlp_ensemble, "ensemble_hit", 0.75), (mq.ensemble_vote, "ensemble_hit", 0.75), (mq.classifier_detect, "hit", 0.55), (so.online_update, "hit", 0.9)])
def test_models_are_right_as_often_as_stated(spark, query, hit, least):
    got = query(spark, MEDIUM).cache()
    assert right(got, hit) >= least and got.select(hit).distinct().count() == 2


def test_outliers_are_few_and_lie_further_out(spark):
    got = mq.isolation_forest(spark, MEDIUM).toPandas()
    assert got.outlier.between(0, 1).all() and 0.02 <= got.is_outlier.mean() <= 0.0501
    assert got.value[got.is_outlier].mean() > got.value[~got.is_outlier].mean()
    tokens = mq.stat_anomaly_iforest(spark, MEDIUM).toPandas()
    assert (tokens.hit == (tokens.ratio > 0.2)).all() and tokens.hit.any() and not tokens.hit.all()


def test_fitted_models_among_the_detectors(spark):
    got = mq.prompt_risk_models(spark, MEDIUM).toPandas()
    assert (got.attacks.str.contains("ENSEMBLE_CLASSIFIER") == got.fit_hit).all() and (got.attack_risk >= got.plain - 1e-6).all()
    enhanced = mq.detect_enhanced_models(spark, MEDIUM).toPandas()
    assert (enhanced.attacks.str.contains("ENSEMBLE") == enhanced.ensemble_hit).all() and enhanced.ensemble_hit.nunique() == 2
