"""Score-to-level ladders and recommended actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(score: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """First name whose bound lies strictly below the score."""
    chain = F.when(score > steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        chain = chain.when(score > bound, name)
    return chain.otherwise(default)


def shift_severity(magnitude: Column) -> Column:
    return ladder(magnitude, [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low")


def anomaly_severity(score: Column) -> Column:
    return ladder(score, [(0.9, "critical"), (0.7, "high"), (0.5, "medium")], "low")


def confidence_severity(confidence: Column) -> Column:
    return ladder(confidence, [(0.9, "CRITICAL"), (0.7, "HIGH"), (0.5, "MEDIUM")], "LOW")


def risk_level(score: Column, threshold: float = 0.5) -> Column:
    return (
        F.when(score < threshold, "low")
        .when(score >= 0.8, "critical")
        .when(score >= 0.6, "high")
        .otherwise("medium")
    )


def recommend_action(adversarial: Column, risk: Column, uncertainty: Column, sophistication: Column) -> Column:
    return (
        F.when(~adversarial, "allow")
        .when(risk > 0.8, "block")
        .when(risk > 0.6, "flag_for_review")
        .when(uncertainty > 0.7, "request_additional_analysis")
        .when(sophistication > 0.7, "escalate_to_human_review")
        .otherwise("monitor")
    )


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x, 2))


def explain_detections(names: Column, confidence: Column, uncertainty: Column, breakdown: Column) -> Column:
    """Sentence for a set of hits; `breakdown` is ARRAY<STRUCT<name, score>>."""
    order = F.array_sort(
        breakdown,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .when(a["name"] < b["name"], -1)
        .when(a["name"] > b["name"], 1)
        .otherwise(0),
    )
    top = F.transform(
        F.slice(order, 1, 3), lambda s: F.concat(s["name"], F.lit("("), two_decimals(s["score"]), F.lit(")"))
    )
    text = F.concat(
        F.lit("Detected "), F.size(names).cast("string"), F.lit(" attack type(s): "), F.array_join(names, ", "),
        F.lit(". Overall confidence: "), two_decimals(confidence),
        F.lit(", uncertainty: "), two_decimals(uncertainty),
        F.lit(". Top signals: "), F.array_join(top, ", "),
    )
    return F.when(F.size(names) == 0, "No adversarial attacks detected.").otherwise(text)
