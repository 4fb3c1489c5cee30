"""Queries that train and apply models.

A fit has no SQL, so these return what the models decide (verdicts, scores, votes) without a statement; their quality is held in
tests. The scaler is exact throughout.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import datasets as ds
from wardline.operators import detectors as dt
from wardline.operators import enhanced as en
from wardline.operators import models as ml
from wardline.operators import risk as rk
from wardline.operators import tokens as tk
from wardline.operators import trainer as tr
from wardline.operators.rows import inline_rows
from wardline.plans.common import load, mixed_prompts, rounded, section, sql_r6
from wardline.plans.detector_queries import ESA_SCALE, analysed_mixed, labelled_documents
from wardline.plans.fusion_queries import CONFIG
from wardline.plans.text_queries import AVG_WORD, PUNCT, SPECIAL, UPPER, W, sql_ratio
from wardline.plans.vector_queries import ANALYSIS, reference
from wardline.functions import text as tx
from wardline.session import checkpointed

QUERIES, ORACLE, query = section()

TEXT_FEATURES = ["prompt_length", "word_count", "avg_word_length", "punctuation_density", "uppercase_ratio", "special_char_ratio"]
SQL_TEXT_FEATURES = f"""SELECT doc_id, length(text)::DOUBLE AS prompt_length, len({W})::DOUBLE AS word_count, {AVG_WORD} AS avg_word_length,
    {sql_ratio(PUNCT)} AS punctuation_density, {sql_ratio(UPPER)} AS uppercase_ratio, {sql_ratio(SPECIAL)} AS special_char_ratio FROM documents JOIN labels USING (doc_id)"""


def training_rows(spark, sf):
    """Cheap text features of every labelled document, computed once; junk is the class to find."""
    d = labelled_documents(spark, sf)
    f = {n: c.cast("double") for n, c in tx.context_features(F.col("text")).items()}
    return checkpointed(d.select("doc_id", (1 - F.col("quality")).alias("label"), *[c.alias(n) for n, c in f.items()]))


@query(
    "fit_scaler",
    "SELECT doc_id, " + ", ".join(sql_r6(f"coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_samp({n}) OVER (), 0), 0)") + f" AS {n}" for n in TEXT_FEATURES) + f" FROM ({SQL_TEXT_FEATURES})",
)
def fit_scaler(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = training_rows(spark, sf)
    scaled = ml.fit_scaler(rows, TEXT_FEATURES).transform(rows).withColumn("v", vector_to_array("scaled"))
    return rounded(scaled.select("doc_id", *[F.col("v")[i].alias(n) for i, n in enumerate(TEXT_FEATURES)]), *TEXT_FEATURES)


@query("fit_logistic")
def fit_logistic(spark, sf):
    rows = training_rows(spark, sf)
    return rounded(ml.score_model(rows, ml.fit_logistic(rows, TEXT_FEATURES, iterations=100)).select("doc_id", "label", "hit", "probability"), "probability")


def fitted_classifier(rows):
    """The twelve-feature classifier, fitted on the training part of analysed prompts with a known truth."""
    parts = checkpointed(ds.split(rows, "prompt_id"))  # training reads the features several times
    return ml.fit_logistic(parts.where("part = 'train'").drop("part"), dt.CLASSIFIER_FEATURES, iterations=50), parts


@query("classifier_detect")
def classifier_detect(spark, sf):
    """The twelve-feature classifier trained on prompts with a known attack, applied to all of them."""
    rows = analysed_mixed(spark, sf).select("prompt_id", F.col("truth").alias("label"), *[c.alias(n) for n, c in dt.classifier_features().items()])
    model, parts = fitted_classifier(rows)
    return rounded(ml.score_model(parts, model).select("prompt_id", "part", "label", "hit", "probability"), "probability")


@query("prompt_risk_models")
def prompt_risk_models(spark, sf):
    """The full score with fitted models among the detectors: the classifier and a forest over the prompt features.

    A prompt reports ENSEMBLE_CLASSIFIER exactly where the fitted model says so, and its risk is never below that without
    the models (`plain`).
    """
    prompts = mixed_prompts(spark, sf)
    analysed = analysed_mixed(spark, sf).select("prompt_id", F.col("truth").alias("label"), *[c.alias(n) for n, c in dt.classifier_features().items()])
    model, parts = fitted_classifier(analysed)
    forest = ml.fit_isolation_forest(parts, dt.CLASSIFIER_FEATURES, ["prompt_id"], trees=20)

    def models(df):
        scored = ml.score_model(df.withColumns(dt.classifier_features()), model, "fit_hit", "fit_p")
        scored = ml.score_isolation_forest(scored, forest, dt.CLASSIFIER_FEATURES, out="fit_outlier").drop(*set(dt.CLASSIFIER_FEATURES) - set(df.columns))
        far = F.col("fit_outlier") > 0.6
        return scored, {
            "ENSEMBLE_CLASSIFIER": dt.verdict(F.col("fit_hit"), F.col("fit_p"), F.col("fit_p")),
            "ISOLATION_FOREST": dt.verdict(far, F.col("fit_outlier"), F.col("fit_outlier")),
        }

    known = tk.prepared(reference(spark, sf))
    with_models = rk.prompt_risk(prompts, known, "prompt_id", ANALYSIS, CONFIG, ESA_SCALE, models=models)
    plain = rk.prompt_risk(prompts, known, "prompt_id", ANALYSIS, CONFIG, ESA_SCALE).select("prompt_id", F.col("attack_risk").alias("plain"))
    fits = checkpointed(with_models.select("prompt_id", F.array_join("attacks", ",").alias("attacks"), "fit_hit", "fit_p", "fit_outlier", "attack_risk"))
    return rounded(fits.join(plain, "prompt_id"), "fit_p", "fit_outlier", "attack_risk", "plain")


@query("random_forest")
def random_forest(spark, sf):
    rows = training_rows(spark, sf)
    return rounded(ml.score_model(rows, ml.fit_random_forest(rows, TEXT_FEATURES)).select("doc_id", "label", "hit", "probability"), "probability")


def voted(scored):
    """Votes and probabilities of several models as their verdict: hit, mean probability, spread."""
    verdict = en.ensemble_verdict(F.col("votes"), F.col("probabilities"))
    return rounded(scored.select("doc_id", "label", "votes", *[c.alias(n) for n, c in verdict.items()]), "ensemble", "ensemble_uncertainty")


@query("mlp_ensemble")
def mlp_ensemble(spark, sf):
    """Five networks with the mixed loss on bootstrap samples, stopped early on a validation part."""
    rows = training_rows(spark, sf)
    return voted(tr.score_networks(rows, tr.fit_networks(rows, "doc_id", TEXT_FEATURES), TEXT_FEATURES))


MISS_WEIGHTS = [1.0, 4.0, 16.0]


@query("miss_weighted_training")
def miss_weighted_training(spark, sf):
    """Misses and false alarms of networks whose losses weigh a miss more and more, on rows they learned from and on others."""
    rows = checkpointed(ds.split(training_rows(spark, sf), "doc_id"))
    losses = [tr.Loss(focal=0.0, missed=1.0, miss_weight=w) for w in MISS_WEIGHTS]
    fitted = tr.fit_networks(rows.where("part = 'train'"), "doc_id", TEXT_FEATURES, losses=losses, resample=False)
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, MISS_WEIGHTS)).alias("miss_weight"), F.col("votes").alias("vote")))
    said = tr.score_networks(rows, fitted, TEXT_FEATURES).select("part", "label", each.alias("e")).select("part", "label", "e.*")
    miss, alarm = (F.col("label") == 1) & (F.col("vote") == 0), (F.col("label") == 0) & (F.col("vote") == 1)
    counts = said.groupBy("miss_weight", "part").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(miss).alias("missed"), F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(alarm).alias("false_alarms"))
    return rounded(counts.withColumn("miss_rate", tx.ratio(F.col("missed"), F.col("positives"))), "miss_rate")


@query("ensemble_vote")
def ensemble_vote(spark, sf):
    """Logistic regression and a random forest vote on every labelled document."""
    rows = training_rows(spark, sf)
    models = [ml.fit_logistic(rows, TEXT_FEATURES, iterations=50), ml.fit_random_forest(rows, TEXT_FEATURES, trees=20)]
    return voted(ml.score_ensemble(rows, models))


@query("detect_enhanced_models")
def detect_enhanced_models(spark, sf):
    """The sixteen-feature detection with a fitted ensemble among its five detectors."""
    rows = checkpointed(en.features16(analysed_mixed(spark, sf), radius=1).select("prompt_id", "text", F.col("truth").alias("label"), *en.FEATURES))
    fitted = tr.fit_networks(rows, "prompt_id", en.FEATURES)
    verdict = en.ensemble_verdict(F.col("votes"), F.col("probabilities"))
    scored = tr.score_networks(rows, fitted, en.FEATURES).withColumns({"ensemble_hit": verdict["ensemble_hit"], "ensemble": verdict["ensemble"]})
    found = en.detect_enhanced(scored, ensemble=("ensemble_hit", "ensemble"))
    return rounded(found.select("prompt_id", "label", F.array_join("attacks", ",").alias("attacks"), "ensemble_hit", "ensemble", "confidence", "uncertainty", "risk", "action"), "ensemble", "confidence", "uncertainty", "risk")


TOKEN_FEATURES = ["anomaly", "max_sim", "mean_sim", "min_sim", "std_sim", "length"]


def token_rows(spark, sf):
    a = analysed_mixed(spark, sf)
    zipped = F.arrays_zip("anomaly", "max_sim", "mean_sim", "min_sim", "std_sim", F.transform("tokens", lambda t: F.length(t).cast("double")).alias("length"))
    named = F.transform(zipped, lambda z, i: F.struct(i.alias("pos"), *[z[n].alias(n) for n in TOKEN_FEATURES]))
    return inline_rows(a, ["prompt_id", "truth"], named, "anomaly")


@query("isolation_forest")
def isolation_forest(spark, sf):
    """Outlier score of every event by value, hour and parameter; the flagged ones are the top twentieth."""
    e = load(spark, sf, "events").select(
        "event_id", "value", F.hour("ts").cast("double").alias("hour"), F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    features = ["value", "hour", "k"]
    scored = ml.score_isolation_forest(e, ml.fit_isolation_forest(e, features, ["event_id"]), features)
    return rounded(ml.flag_outliers(checkpointed(scored), contamination=0.05).select("event_id", "value", "outlier", "is_outlier"), "outlier")


@query("stat_anomaly_iforest")
def stat_anomaly_iforest(spark, sf):
    """One forest over all tokens; a prompt is a hit when too many of its tokens are outliers."""
    tokens = checkpointed(token_rows(spark, sf))
    forest = ml.fit_isolation_forest(tokens, TOKEN_FEATURES, ["prompt_id", "pos"], trees=50)
    flagged = ml.flag_outliers(checkpointed(ml.score_isolation_forest(tokens, forest, TOKEN_FEATURES).select("prompt_id", "outlier")))
    per_prompt = flagged.groupBy("prompt_id").agg(F.count("*").alias("tokens"), F.avg(F.col("is_outlier").cast("int")).alias("ratio"), F.max("outlier").alias("outlier"))
    v = per_prompt.withColumn("v", dt.outlier_ratio(F.col("ratio")))
    return rounded(v.select("prompt_id", "tokens", "ratio", "outlier", F.col("v.hit").alias("hit"), F.col("v.confidence").alias("confidence")), "ratio", "outlier", "confidence")
