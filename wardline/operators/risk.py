"""Risk aggregation and the full prompt score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import severity as sv
from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators import detectors as dt
from wardline.operators import enhanced as en
from wardline.operators import fusion as fu
from wardline.operators import tokens as tk


def risk_aggregate(embedding: Column, adversarial: Column, anomaly: Column | None = None, threshold: float = 0.5) -> dict[str, Column]:
    """Weighted risk, verdict and level; without the anomaly part the weights are .4 and .6."""
    if anomaly is None:
        score = 0.4 * embedding + 0.6 * adversarial
    else:
        score = 0.3 * embedding + 0.4 * adversarial + 0.3 * anomaly
    return {"risk_score": score, "is_malicious": score >= threshold, "risk_level": sv.risk_level(score, threshold)}


def extract_signals() -> dict[str, Column]:
    """The eight fusion signals of a prompt that has features and verdicts."""
    steps = sp.embedding_steps(F.col("cosines"))
    return {
        "embedding_distance": 1.0 - sp.mean_of(F.col("max_sim")),
        "semantic_similarity": F.col("semantic_consistency"),
        "token_frequency": F.col("token_frequency_anomaly"),
        "context_coherence": 1.0 - F.col("overall_anomaly"),
        "gradient_magnitude": sp.mean_of(steps),
        "statistical_outlier": F.col("embedding_outlier_score"),
        "linguistic_pattern": tx.linguistic_anomaly(F.col("text")),
        "ensemble_consensus": F.col("detection_confidence"),
    }


def with_signals(df: DataFrame) -> DataFrame:
    """Add the signals as a struct column."""
    return df.withColumn("signals", F.struct(*[v.alias(s) for s, v in extract_signals().items()]))


def prompt_risk(
    df: DataFrame, reference: DataFrame, id_col: str, params: tk.TokenParams = tk.TokenParams(),
    fusion: fu.FusionConfig = fu.FusionConfig(), esa_scale: float = 10.0, recent_rate: Column | None = None,
    hour: Column | None = None, models: Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]] | None = None,
) -> DataFrame:
    """The full score of every prompt in `text`: attacks, confidence, risk level and explanation.

    `models` gets the analysed prompts and gives them back with the columns of fitted models, and verdicts on those columns by
    detector name (see `detectors.verdict`).
    """
    analysed = tk.analyze_tokens(df, reference, id_col, params=params)
    featured = en.features16(analysed, radius=params.radius, embedder=params.embedder)
    featured, extra = models(featured) if models else (featured, None)
    detected = dt.detect_attacks(featured, esa_scale=esa_scale, extra=extra)
    signalled = with_signals(detected)
    values = {s: F.col(f"signals.{s}") for s in fu.SIGNALS}
    decided = fu.detect_anomalies(signalled, values, fusion, recent_rate=recent_rate, hour=hour)
    broken = dt.is_unscorable(F.col("text"))
    risk = risk_aggregate(F.col("overall_anomaly"), F.col("attack_risk"), F.col("anomaly_confidence"))
    scored = decided.withColumns(risk)
    return scored.withColumns(
        {
            "is_malicious": broken | F.col("is_malicious"),
            "risk_level": F.when(broken, "critical").otherwise(F.col("risk_level")),
            "risk_score": F.when(broken, 0.0).otherwise(F.col("risk_score")),
            "explanation": F.concat(
                F.lit("Risk "), sv.two_decimals(vx.clip(F.col("risk_score"))), F.lit(". "), F.col("detection_text")
            ),
        }
    )


def batch_score(df: DataFrame, text_col: str, score: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Score each distinct text once and give every row its result.

    `score` gets (text_key, text); a null text has a key of its own. One row per
    distinct text joins all its copies; Spark splits a text with very many copies.
    """
    keyed = df.withColumn("text_key", F.coalesce(F.sha2(text_col, 256), F.lit("null")))
    distinct = keyed.groupBy("text_key").agg(F.first(text_col).alias("text"))
    # Few bytes are much work here: the distinct texts are dealt to all tasks, whatever their size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results = score(distinct.repartition(parts, "text_key")).select("text_key", *columns)
    return keyed.join(results, "text_key").drop("text_key")


def plugin_scores(df: DataFrame, plugins: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """One struct per plugin (result, error) in `plugins`; a failing plugin leaves its error and the row stays.

    A plugin takes the DataFrame and returns a Column; it should use `try_` functions
    for row-level failures, whose null result is reported as an error.
    """
    parts = []
    for name, plugin in plugins.items():
        try:
            result = plugin(df).cast("double")
            failed = F.when(result.isNull(), "no result")
        except Exception as error:  # a plugin that cannot even be planned must not stop the others
            result, failed = F.lit(None).cast("double"), F.lit(f"{type(error).__name__}")
        parts.append(F.struct(result.alias("result"), failed.alias("error")).alias(name))
    return df.withColumn("plugins", F.struct(*parts))
