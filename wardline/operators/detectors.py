"""Attack detectors over the token analysis of a prompt (one row in, one row out).

All detectors are column expressions on the arrays that
`wardline.operators.tokens.analyze_tokens` leaves in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import severity as sv
from wardline.functions import spans as sp
from wardline.functions import text as tx
from wardline.functions import vectors as vx

# Weight of a hit of each detector in the risk score.
ATTACK_WEIGHTS = {
    "ESA": 0.9,
    "CAP": 0.8,
    "STATISTICAL_ANOMALY": 0.6,
    "ENSEMBLE_CLASSIFIER": 0.7,
    "DETECTION_ERROR": 1.0,
}
OTHER_WEIGHT = 0.5

CLASSIFIER_FEATURES = [
    "prompt_length", "num_tokens", "avg_token_length", "mean_anomaly", "max_anomaly", "std_anomaly",
    "num_shifts", "max_shift", "mean_similarity", "min_similarity", "overall_anomaly", "num_anomalies",
]


def verdict(hit: Column, score: Column, measure: Column) -> Column:
    """hit, confidence (0 without a hit) and the number that the explanation shows."""
    hit = F.coalesce(hit, F.lit(False))
    return F.struct(
        hit.alias("hit"), F.when(hit, score).otherwise(0.0).alias("confidence"), measure.cast("double").alias("measure")
    )


def esa(cosines: Column, scale: float = 10.0, threshold: float = 0.8) -> Column:
    """Embedding shift: the largest step between neighbouring token embeddings."""

    def judge(steps: Column) -> Column:
        limit = sp.mean_of(steps) + 2.0 * vx.std(steps)
        far = vx.let(limit, lambda cut: F.size(F.filter(steps, lambda g: g > cut)))
        size = F.coalesce(F.least(F.lit(1.0), F.array_max(steps) / scale), F.lit(0.0))
        return verdict(size > (1.0 - threshold), size, far)

    return vx.let(sp.embedding_steps(cosines), judge)


def cap_flags(df_cols: dict[str, Column] | None = None, anomaly_cut: float = 0.6, masked_sim: float = 0.7) -> list[Column]:
    """The four signs of contrastive prompting; `shift_counts` among `df_cols` stands for the list of shifts."""
    n, counted = F.size("tokens"), (df_cols or {}).get("shift_counts")
    if counted is None:
        strong = F.size(F.filter("shifts", lambda s: s["magnitude"] > 0.5))
        windows = F.size(F.filter("shifts", lambda s: s["type"] == "window_based_shift"))
    else:
        strong, windows = counted["strong"], counted["windows"]
    masked = F.size(
        F.filter(F.zip_with("anomaly", "max_sim", lambda a, m: (a > anomaly_cut) & (m > masked_sim)), lambda x: x)
    )
    gap = (1.0 - F.col("overall_anomaly")) - (1.0 - tx.ratio(masked, n))
    return [strong > 2, masked > n * 0.2, gap > 0.3, windows > 1]


def cap(threshold: float = 0.75, df_cols: dict[str, Column] | None = None) -> Column:
    a, b, c, d = [f.cast("int") for f in cap_flags(df_cols)]
    score = (a + b + c + d) / F.lit(4.0)
    return verdict(score >= (1.0 - threshold), score, score)


def statistical(anomaly: Column) -> Column:
    """Mean or spread of the token anomalies out of range."""

    def judge(pair: Column) -> Column:
        mean, spread = pair["m"], pair["s"]
        return verdict((mean > 0.7) | (spread > 0.3), F.least(F.lit(1.0), (mean + spread) / 2.0), mean)

    moments = F.struct(sp.mean_of(anomaly).alias("m"), F.coalesce(vx.std(anomaly), F.lit(0.0)).alias("s"))
    return vx.let(moments, judge)


def outlier_ratio(ratio: Column, cut: float = 0.2) -> Column:
    """Verdict from the share of a prompt's tokens that a fitted isolation forest calls outliers."""
    return verdict(ratio > cut, F.least(F.lit(1.0), 2.0 * ratio), ratio)


def classifier_features(text_col: str = "text") -> dict[str, Column]:
    """The 12 classifier features in their fixed order."""
    anomaly, max_sim = F.col("anomaly"), F.col("max_sim")
    largest = F.array_max(F.transform("shifts", lambda s: s["magnitude"]))
    columns = [
        F.length(text_col).cast("double"),
        F.size("tokens").cast("double"),
        tx.ratio(vx.sum_of(F.transform("tokens", lambda t: F.length(t).cast("double"))), F.size("tokens")),
        sp.mean_of(anomaly),
        F.coalesce(F.array_max(anomaly), F.lit(0.0)),
        F.coalesce(vx.std(anomaly), F.lit(0.0)),
        F.size("shifts").cast("double"),
        F.coalesce(largest, F.lit(0.0)),
        sp.mean_of(max_sim),
        F.coalesce(F.array_min(max_sim), F.lit(0.0)),
        F.col("overall_anomaly"),
        F.size("anomalies").cast("double"),
    ]
    return dict(zip(CLASSIFIER_FEATURES, columns))


def attack_risk(confidences: dict[str, Column]) -> Column:
    """Largest weighted confidence, at most 1; absent detectors give 0."""
    weighted = [c * ATTACK_WEIGHTS.get(name, OTHER_WEIGHT) for name, c in confidences.items()]
    best = weighted[0] if len(weighted) == 1 else F.greatest(*weighted)
    return F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0)))


# Sentences of the explanation.
EXPLANATIONS = {
    "ESA": ("- Embedding Shift Attack: ", " perturbations detected", "count"),
    "CAP": ("- Contrastive Adversarial Prompting: ", " manipulation score", "score"),
    "STATISTICAL_ANOMALY": ("- Statistical Anomaly: ", " anomaly ratio", "score"),
    "ENSEMBLE_CLASSIFIER": ("- Ensemble Classification: ", " adversarial probability", "score"),
    "ISOLATION_FOREST": ("- Isolation Forest: ", " outlier score", "score"),
    "DETECTION_ERROR": ("- DETECTION_ERROR: Detection triggered", "", None),
}


def explanation(verdicts: dict[str, Column], confidence: Column) -> Column:
    parts = []
    for name, v in verdicts.items():
        head, tail, kind = EXPLANATIONS[name]
        shown = v["measure"].cast("long").cast("string") if kind == "count" else sv.two_decimals(v["measure"])
        body = F.lit(head) if kind is None else F.concat(F.lit(head), shown, F.lit(tail))
        parts.append(F.when(v["hit"], body))
    found = F.array_compact(F.array(*parts))
    text = F.concat(
        F.lit("Detected "), F.size(found).cast("string"), F.lit(" potential attack(s) with "),
        sv.two_decimals(confidence), F.lit(" confidence: "), F.array_join(found, " "),
    )
    return F.when(F.size(found) == 0, "No adversarial attacks detected. The prompt appears to be legitimate.").otherwise(text)


def is_unscorable(text: Column) -> Column:
    """Rows no detector can judge: null or blank."""
    return text.isNull() | (F.regexp_replace(text, tx.BLANK, "") == "")


def detect_attacks(
    df: DataFrame, text_col: str = "text", esa_scale: float = 10.0, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Run the detectors on analysed prompts.

    Adds `attacks`, `detection_confidence`, `is_adversarial`, `attack_risk` and
    `detection_text`. `extra` holds verdicts of fitted models by detector name.
    Rows that cannot be scored stay and fail safe: adversarial, confidence 1.
    """
    counted = {c: F.col(c) for c in df.columns if c == "shift_counts"}
    named = {"ESA": esa(F.col("cosines"), esa_scale), "CAP": cap(df_cols=counted), "STATISTICAL_ANOMALY": statistical(F.col("anomaly"))}
    named.update(extra or {})
    broken = is_unscorable(F.col(text_col))
    named["DETECTION_ERROR"] = verdict(broken, F.lit(1.0), F.lit(1.0))
    kept = {n: f"_v_{n}" for n in named}
    scored = df.withColumns({kept[n]: v for n, v in named.items()})
    for n in named:
        if n != "DETECTION_ERROR":
            none = verdict(F.lit(False), F.lit(0.0), F.lit(0.0))
            scored = scored.withColumn(kept[n], F.when(F.col("_v_DETECTION_ERROR.hit"), none).otherwise(F.col(kept[n])))
    hits = {n: F.col(c) for n, c in kept.items()}
    attacks = F.array_compact(F.array(*[F.when(v["hit"], F.lit(n)) for n, v in hits.items()]))
    best = F.greatest(*[v["confidence"] for v in hits.values()])
    return scored.withColumns(
        {
            "attacks": attacks,
            "detection_confidence": best,
            "is_adversarial": F.size(attacks) > 0,
            "attack_risk": attack_risk({n: v["confidence"] for n, v in hits.items()}),
            "detection_text": explanation(hits, best),
        }
    ).drop(*kept.values())
