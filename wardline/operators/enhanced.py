"""The sixteen-feature detectors: feature assembly, five scores, uncertainty, risk and action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import geometry as geo
from wardline.functions import severity as sv
from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators.detectors import is_unscorable
from wardline.operators.ordering import exact_percentiles
from wardline.operators.rows import fenced

FEATURES = [
    "embedding_variance", "gradient_magnitude", "embedding_smoothness", "perturbation_signature",
    "semantic_consistency", "paraphrase_similarity", "intent_deviation", "linguistic_naturalness",
    "token_frequency_anomaly", "embedding_outlier_score", "position_entropy", "attention_divergence",
    "token_level_anomaly", "phrase_level_anomaly", "sentence_level_anomaly", "cross_level_consistency",
]

# Features for which there is no model; parameters of `features16`.
DEFAULT_FEATURES = {"paraphrase_similarity": 0.8, "intent_deviation": 0.2, "attention_divergence": 0.3}


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the adaptive thresholds."""

    esa: float = 0.8
    cap: float = 0.75
    risk: float = 0.6
    confidence: float = 0.5
    rate: float = 0.1
    percentile: float = 0.95
    granularity: float = 0.7
    semantic: float = 0.4


def features16(
    df: DataFrame, text_col: str = "text", radius: int = 5, defaults: dict[str, float] | None = None, embedder: vx.Embedder = vx.HASHED,
) -> DataFrame:
    """Add the sixteen features to analysed prompts (see `tokens.analyze_tokens`)."""
    fixed = {**DEFAULT_FEATURES, **(defaults or {})}
    text, steps = F.coalesce(F.col(text_col), F.lit("")), sp.embedding_steps(F.col("cosines"))
    base = fenced(df, {"_sentences": sp.sentence_units(text, embedder)})
    sizes = F.transform("_sentences", lambda s: F.size(s))
    base = base.withColumn("_stats", geo.text_statistics_udf(geo.space_of(embedder), radius)(F.col("buckets"), F.flatten("_sentences"), sizes))
    found = base.withColumns(
        {
            "embedding_variance": F.col("_stats.variance"),
            "gradient_magnitude": F.col("_stats.gradient"),
            "embedding_smoothness": F.when(F.size("buckets") < 2, 1.0).otherwise(1.0 / (1.0 + sp.mean_of(steps))),
            "perturbation_signature": F.col("_stats.signature"),
            "semantic_consistency": F.col("_stats.consistency"),
            "linguistic_naturalness": tx.naturalness(text, F.size("_sentences")),
            "token_frequency_anomaly": tx.token_frequency_anomaly(F.col("tokens")),
            "embedding_outlier_score": F.col("_stats.outlier"),
            "position_entropy": sp.position_entropy(F.col("anomaly")),
            "token_level_anomaly": F.col("overall_anomaly"),
            "phrase_level_anomaly": F.col("_stats.phrase"),
            "sentence_level_anomaly": F.col("_stats.sentence"),
            **{name: F.lit(value) for name, value in fixed.items()},
        }
    ).drop("_stats", "_sentences")
    return found.withColumn(
        "cross_level_consistency",
        sp.cross_level_consistency(F.col("token_level_anomaly"), F.col("phrase_level_anomaly"), F.col("sentence_level_anomaly")),
    )


def esa_score(f: dict[str, Column]) -> Column:
    return (
        0.3 * f["embedding_variance"] + 0.4 * f["gradient_magnitude"] + 0.2 * (1.0 - f["embedding_smoothness"])
        + 0.1 * f["perturbation_signature"]
    )


def cap_score(f: dict[str, Column]) -> Column:
    return (
        0.35 * (1.0 - f["semantic_consistency"]) + 0.25 * (1.0 - f["paraphrase_similarity"]) + 0.25 * f["intent_deviation"]
        + 0.15 * (1.0 - f["linguistic_naturalness"])
    )


def granularity_score(f: dict[str, Column]) -> Column:
    level = F.greatest(f["token_level_anomaly"], f["phrase_level_anomaly"], f["sentence_level_anomaly"])
    return level + 0.3 * (1.0 - f["cross_level_consistency"])


def semantic_score(f: dict[str, Column]) -> Column:
    return 1.0 - (f["semantic_consistency"] + (1.0 - f["intent_deviation"]) + f["linguistic_naturalness"]) / 3.0


def feature_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in FEATURES}


def sophistication(above_half: Column, f: dict[str, Column]) -> Column:
    mean = (f["gradient_magnitude"] + f["semantic_consistency"] + f["cross_level_consistency"]) / 3.0
    return vx.clip(above_half / 5.0 + 0.5 * mean)


def enhanced_risk(hits: Column, best: Column, uncertainty: Column, f: dict[str, Column]) -> Column:
    by_features = (f["perturbation_signature"] + f["intent_deviation"] + (1.0 - f["semantic_consistency"])) / 3.0
    total = 0.4 * (hits / 7.0) + 0.4 * best + 0.2 * by_features - 0.3 * uncertainty
    return F.when(hits > 0, vx.clip(total)).otherwise(0.0)


def ensemble_verdict(votes: Column, probabilities: Column, threshold: float = 0.5) -> dict[str, Column]:
    """Share of votes, mean probability and spread of k fitted models; without models 0, 0 and 1."""
    share, mean = sp.mean_of(votes), sp.mean_of(probabilities)
    return {
        "ensemble_hit": (share > 0.5) & (mean > threshold),
        "ensemble": mean,
        "ensemble_uncertainty": F.coalesce(vx.std(probabilities), F.lit(1.0)),
    }


def detect_enhanced(
    df: DataFrame, text_col: str = "text", thresholds: Thresholds = Thresholds(), ensemble: tuple[str, str] | None = None
) -> DataFrame:
    """Five detections on the sixteen features, then uncertainty, sophistication, risk and action.

    `ensemble` names the hit and score columns of fitted models. Rows that cannot
    be scored stay: not adversarial, uncertainty 1, action `retry_analysis`.
    """
    f = feature_columns()
    scored = df.withColumns(
        {
            "esa_score": esa_score(f),
            "cap_score": cap_score(f),
            "granularity_score": granularity_score(f),
            "ensemble_score": F.col(ensemble[1]) if ensemble else F.lit(0.0),
            "semantic_score": semantic_score(f),
        }
    )
    hit = {
        "ESA": F.col("esa_score") > thresholds.esa,
        "CAP": F.col("cap_score") > thresholds.cap,
        "MULTI_GRANULARITY": F.col("granularity_score") > thresholds.granularity,
        "ENSEMBLE": F.col(ensemble[0]) if ensemble else F.lit(False),
        "SEMANTIC_INCONSISTENCY": F.col("semantic_score") > thresholds.semantic,
    }
    names = ["esa_score", "cap_score", "granularity_score", "ensemble_score", "semantic_score"]
    bad = is_unscorable(F.col(text_col))
    judged = scored.withColumns(
        {
            "attacks": F.when(bad, F.array().cast("array<string>")).otherwise(
                F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, h in hit.items()]))
            ),
            "confidence": F.greatest(*[F.when(h, F.col(n)).otherwise(0.0) for h, n in zip(hit.values(), names)]),
            "uncertainty": F.when(bad, 1.0).otherwise(vx.std(F.array(*names))),
            "_half": sum(((F.col(n) > 0.5).cast("int") for n in names), F.lit(0)),
        }
    )
    final = judged.withColumns(
        {
            "confidence": F.when(bad, 0.0).otherwise(F.col("confidence")),
            "is_adversarial": F.size("attacks") > 0,
            "sophistication": F.when(bad, 0.0).otherwise(sophistication(F.col("_half"), f)),
            "risk": enhanced_risk(F.size("attacks"), F.col("confidence"), F.col("uncertainty"), f),
        }
    )
    breakdown = F.array(*[F.struct(F.lit(n.removesuffix("_score")).alias("name"), F.col(n).alias("score")) for n in names])
    action = sv.recommend_action(F.col("is_adversarial"), F.col("risk"), F.col("uncertainty"), F.col("sophistication"))
    return final.withColumns(
        {
            "action": F.when(bad, "retry_analysis").otherwise(action),
            "explanation": sv.explain_detections(F.col("attacks"), F.col("confidence"), F.col("uncertainty"), breakdown),
        }
    ).drop("_half")


def dynamic_threshold(
    df: DataFrame, keys: list[str], score: str, label: str, start: float, params: Thresholds = Thresholds(),
    low: float = 0.1, high: float = 0.9, minimum: int = 10,
) -> DataFrame:
    """One adaptation step per key: towards the middle of p95 of the positives and p5 of the negatives."""
    p = params.percentile
    both = exact_percentiles(df, [*keys, label], F.col(score), {"high": p, "low": 1.0 - p}, count="n")
    joined = both.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max(F.when(F.col(label), F.col("high"))).alias("p_pos"), F.max(F.when(~F.col(label), F.col("low"))).alias("p_neg")
    )
    best = (F.col("p_pos") + F.col("p_neg")) / 2.0
    moved = vx.clip(start + params.rate * (best - start), low, high)
    return joined.withColumn(
        "threshold", F.when((F.col("n") >= minimum) & best.isNotNull(), moved).otherwise(F.lit(start))
    )
