"""Fusion of eight detection signals into one decision.

Signals are columns of the prompt's row, so fusion is arithmetic without a
shuffle; the configuration turns into literals when the plan is built.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.functions import vectors as vx
from wardline.operators.ordering import exact_percentiles, rolling_sum, running_index

SIGNALS = [
    "embedding_distance", "semantic_similarity", "token_frequency", "context_coherence",
    "gradient_magnitude", "statistical_outlier", "linguistic_pattern", "ensemble_consensus",
]

# Fusion weight per signal; a signal without one counts .1.
WEIGHTS = {
    "embedding_distance": 0.25,
    "semantic_similarity": 0.20,
    "token_frequency": 0.15,
    "context_coherence": 0.15,
    "gradient_magnitude": 0.10,
    "statistical_outlier": 0.10,
    "linguistic_pattern": 0.05,
}
UNKNOWN_WEIGHT = 0.1

# Security level -> factor on the base threshold, and on the final one.
LEVEL_FACTOR = {"LOW": 0.7, "MEDIUM": 1.0, "HIGH": 1.3, "CRITICAL": 1.6}
LEVEL_ADJUSTMENT = {"LOW": 1.2, "MEDIUM": 1.0, "HIGH": 1.0, "CRITICAL": 0.8}


@dataclass(frozen=True)
class ThresholdConfig:
    base: float = 0.5
    low: float = 0.1
    high: float = 0.95
    rate: float = 0.1
    window: int = 1000
    percentile: float = 95.0
    sensitivity: float = 1.0
    context_weight: float = 0.3


@dataclass(frozen=True)
class FusionConfig:
    level: str = "MEDIUM"
    method: str = "weighted_average"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    reliability: dict[str, float] = field(default_factory=dict)
    thresholds: dict[str, ThresholdConfig] = field(default_factory=dict)
    default_threshold: ThresholdConfig = ThresholdConfig()
    consensus: float = 0.6
    penalty: float = 0.2
    normalize_threshold: bool = False

    def threshold_of(self, signal: str) -> ThresholdConfig:
        return self.thresholds.get(signal, self.default_threshold)

    def reliability_of(self, signal: str) -> float:
        return self.reliability.get(signal, 1.0)

    def weight_of(self, signal: str) -> float:
        return normalize_weights(self.weights).get(signal, UNKNOWN_WEIGHT)


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total > 0 else dict(weights)


def normalize_weight_table(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weights of each configuration (a handful of rows per key) scaled to sum to 1."""
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys)))


def level_threshold(base: Column, level: Column, reliability: Column, low: float = 0.1, high: float = 0.95) -> Column:
    """Threshold from the pristine base, the security level and the signal's reliability."""

    def by_level(table: dict[str, float]) -> Column:
        chain = F.when(level == "LOW", table["LOW"]).when(level == "HIGH", table["HIGH"])
        return chain.when(level == "CRITICAL", table["CRITICAL"]).otherwise(table["MEDIUM"])

    start = F.least(base * by_level(LEVEL_FACTOR), F.lit(high))
    return vx.clip(start * (by_level(LEVEL_ADJUSTMENT) * (0.8 + 0.4 * reliability)), low, high)


def level_thresholds(config: FusionConfig, signals: list[str] = SIGNALS, learned: dict[str, Column] | None = None) -> dict[str, Column]:
    """Thresholds of a configuration, as literals; `learned` replaces a base by an adapted one (see `adapt_thresholds`)."""
    out = {}
    for s in signals:
        c, r = config.threshold_of(s), config.reliability_of(s)
        if learned and s in learned:
            out[s] = level_threshold(learned[s], F.lit(config.level), F.lit(r), c.low, c.high)
        else:
            start = min(c.base * LEVEL_FACTOR[config.level], c.high)
            out[s] = F.lit(min(max(start * (LEVEL_ADJUSTMENT[config.level] * (0.8 + 0.4 * r)), c.low), c.high))
    return out


def clip_signals(values: dict[str, Column], scaling: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Signals cut to 0..1, after an optional fitted (mean, std) scaling."""
    scaled = {
        s: (v - scaling[s][0]) / scaling[s][1] if scaling and s in scaling else v for s, v in values.items()
    }
    return {s: vx.clip(v) for s, v in scaled.items()}


def context_adjust(
    values: dict[str, Column], prompt_length: Column, recent_rate: Column, hour: Column, config: FusionConfig
) -> dict[str, Column]:
    """Signals scaled by prompt length, recent anomaly rate and time of day."""
    length = F.least(prompt_length / 100.0, F.lit(1.5))
    rate = 1.0 + (recent_rate - 0.1) * 0.2
    night = F.when((hour < 6) | (hour > 22), 1.1).otherwise(1.0)
    factor = length * 0.3 + rate * 0.4 + night * 0.3
    return {s: vx.clip(v * (factor * config.threshold_of(s).context_weight)) for s, v in values.items()}


def contributions(values: dict[str, Column], thresholds: dict[str, Column], config: FusionConfig) -> dict[str, Column]:
    """Share of each signal in the excess over the thresholds; they sum to 1, or all are 0."""
    raw = {}
    for s, v in values.items():
        t = thresholds[s]
        excess = F.when((v > t) & (t < 1.0), (v - t) / (1.0 - t)).otherwise(0.0)
        raw[s] = excess * (config.weight_of(s) * config.reliability_of(s))
    total = sum(raw.values(), F.lit(0.0))
    return {s: F.when(total > 0, c / total).otherwise(0.0) for s, c in raw.items()}


def fused(score: Column, threshold: Column, confidence: Column) -> Column:
    return F.struct(score.alias("score"), threshold.alias("threshold"), confidence.alias("confidence"))


def fuse_weighted(values: dict[str, Column], thresholds: dict[str, Column], config: FusionConfig) -> Column:
    effective = {s: config.weight_of(s) * config.reliability_of(s) for s in values}
    total = sum(effective.values())
    score = sum((v * effective[s] for s, v in values.items()), F.lit(0.0)) / total if total > 0 else F.lit(0.0)
    limit = sum((thresholds[s] * config.weight_of(s) for s in values), F.lit(0.0))
    if config.normalize_threshold:
        limit = limit / sum(config.weight_of(s) for s in values)
    return fused(score, limit, F.lit(min(total, 1.0)))


def fuse_majority(values: dict[str, Column], thresholds: dict[str, Column], config: FusionConfig) -> Column:
    votes = sum(((v > thresholds[s]).cast("int") for s, v in values.items()), F.lit(0))
    share = votes / F.lit(float(len(values)))
    return fused(share, F.lit(config.consensus), F.abs(share - 0.5) * 2.0)


def fuse_evidence(values: dict[str, Column], thresholds: dict[str, Column], config: FusionConfig) -> Column:
    zero = F.lit(0.0)
    pro = sum((F.greatest(v - thresholds[s], zero) * config.reliability_of(s) for s, v in values.items()), zero)
    contra = sum((F.greatest(thresholds[s] - v, zero) * config.reliability_of(s) for s, v in values.items()), zero)
    unsure = sum((1.0 - config.reliability_of(s)) * 0.1 for s in values)
    total = pro + contra + unsure
    return fused(
        F.when(total > 0, pro / total).otherwise(0.0), F.lit(0.5), F.when(total > 0, 1.0 - unsure / total).otherwise(0.0)
    )


METHODS: dict[str, Callable[..., Column]] = {
    "weighted_average": fuse_weighted, "majority_vote": fuse_majority, "evidence_fusion": fuse_evidence,
}


def fuse(values: dict[str, Column], thresholds: dict[str, Column], config: FusionConfig) -> Column:
    """By method name; an unknown name fuses by weighted average."""
    return METHODS.get(config.method, fuse_weighted)(values, thresholds, config)


def decide(result: Column, config: FusionConfig) -> dict[str, Column]:
    """Decision and confidence from a fusion result; low fusion confidence costs the penalty."""
    score, t, sure = result["score"], result["threshold"], result["confidence"]
    effective = F.when(sure < config.consensus, score * (1.0 - config.penalty)).otherwise(score)
    anomalous = effective > t
    above = F.least(F.coalesce(F.try_divide(effective - t, 1.0 - t), F.lit(0.0)), F.lit(1.0))
    below = F.least(F.coalesce(F.try_divide(t - effective, t), F.lit(0.0)), F.lit(1.0))
    return {
        "is_anomalous": anomalous,
        "anomaly_confidence": F.when(anomalous, above).otherwise(below) * sure,
        "effective_score": effective,
    }


def detect_anomalies(
    df: DataFrame, signals: dict[str, Column], config: FusionConfig, text_col: str = "text",
    recent_rate: Column | None = None, hour: Column | None = None,
) -> DataFrame:
    """Signals to decision. A row with a missing signal is not anomalous, with confidence 0 and threshold .5."""
    rate = F.lit(0.0) if recent_rate is None else recent_rate
    clock = F.lit(12) if hour is None else hour
    stage = df.withColumns({f"_c_{s}": v for s, v in clip_signals(signals).items()})
    clipped = {s: F.col(f"_c_{s}") for s in signals}
    adjusted = context_adjust(clipped, tx.context_features(F.col(text_col))["prompt_length"], rate, clock, config)
    stage = stage.withColumns({f"_a_{s}": v for s, v in adjusted.items()})
    values = {s: F.col(f"_a_{s}") for s in signals}
    thresholds = level_thresholds(config, list(signals))
    parts = contributions(values, thresholds, config)
    stage = stage.withColumns(
        {
            "_fused": fuse(values, thresholds, config),
            "contributions": F.create_map(*[x for s in signals for x in (F.lit(s), parts[s])]),
        }
    )
    whole = sum(signals.values(), F.lit(0.0)).isNotNull()
    verdict = decide(F.col("_fused"), config)
    result = stage.withColumns(
        {
            "fusion_score": F.when(whole, F.col("_fused.score")).otherwise(0.0),
            "fusion_threshold": F.when(whole, F.col("_fused.threshold")).otherwise(0.5),
            "is_anomalous": F.when(whole, verdict["is_anomalous"]).otherwise(False),
            "anomaly_confidence": F.when(whole, verdict["anomaly_confidence"]).otherwise(0.0),
        }
    )
    return result.drop("_fused", *[f"_c_{s}" for s in signals], *[f"_a_{s}" for s in signals])


def recent_anomaly_rate(
    df: DataFrame, keys: list[str], order: list[str], flag: str, last: int = 100, minimum: int = 10,
    block: int = 65536,
) -> DataFrame:
    """Share of anomalous rows among the `last` before each row, 0 before `minimum` rows.

    Rows get their exact index per key, then sums run per block of the index with
    `last` rows of halo, so one busy key spreads over many tasks.
    """
    indexed = running_index(df, keys, order)
    rolled = rolling_sum(indexed, keys, "idx", F.col(flag).cast("int"), last, "_hits", skip_current=True, block=block)
    rate = F.col("_hits") / F.least(F.col("idx"), F.lit(last))
    return rolled.withColumn("recent_rate", F.when(F.col("idx") >= minimum, rate).otherwise(0.0)).drop("_hits")


# --- adaptive thresholds -----------------------------------------------------------------
#
# A step moves the threshold to clip((t + rate (optimum - t)) * sensitivity). Each step is a
# function min(hi, max(lo, a t + b)) with a >= 0, and such functions compose to one of the same
# form: a block of history folds to four numbers without knowing where it starts.


def compose(a1: float, b1: float, lo1: float, hi1: float, a2: float, b2: float, lo2: float, hi2: float):
    """The step (a2, b2, lo2, hi2) after the function (a1, b1, lo1, hi1)."""

    def clamp(x: float) -> float:
        return min(hi2, max(lo2, x))

    return a2 * a1, a2 * b1 + b2, clamp(a2 * lo1 + b2), clamp(a2 * hi1 + b2)


def fold_block(scores: np.ndarray, labels: np.ndarray, own: np.ndarray, first_idx: int, c: ThresholdConfig, minimum: int):
    """Fold the own rows of a block; the rows before them only fill the history window."""
    recent: deque = deque()
    pos: list[float] = []
    neg: list[float] = []
    total = (1.0, 0.0, -np.inf, np.inf)
    a = (1.0 - c.rate) * c.sensitivity
    for k in range(len(scores)):
        recent.append((scores[k], labels[k]))
        insort(pos if labels[k] else neg, scores[k])
        if len(recent) > c.window:
            old, was = recent.popleft()
            side = pos if was else neg
            side.pop(bisect_left(side, old))
        if own[k] and first_idx + k + 1 >= minimum and pos and neg:
            best = (percentile(pos, c.percentile) + percentile(neg, 100.0 - c.percentile)) / 2.0
            step = (a, c.rate * c.sensitivity * best, c.low, c.high)
            total = compose(*total, *step)
    return total


def percentile(ordered: list[float], p: float) -> float:
    """Linear-interpolated percentile of a sorted list."""
    h = (len(ordered) - 1) * p / 100.0
    lo = int(h)
    hi = min(lo + 1, len(ordered) - 1)
    return ordered[lo] + (ordered[hi] - ordered[lo]) * (h - lo)


def adapt_thresholds(
    df: DataFrame, keys: list[str], order: list[str], score: str, label: str,
    config: ThresholdConfig = ThresholdConfig(), minimum: int = 50, block: int = 65536,
) -> DataFrame:
    """Final threshold per key after replaying its whole history in order.

    History is cut into blocks of the exact running index, each with the window's
    rows before it; a block is one bounded task and gives one row. The blocks of a
    key, in order, are then folded over the start value.
    """
    indexed = running_index(df, keys, order).select(
        *keys, "idx", F.col(score).cast("double").alias("_s"), F.col(label).cast("boolean").alias("_l")
    )
    own = F.floor(F.col("idx") / block).cast("long")
    last = F.floor((F.col("idx") + config.window) / block).cast("long")
    copies = indexed.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.col("_own"), last)))
    # A copy only matters where the block has rows of its own.
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        mine = (pdf["_own"] == pdf["_block"]).to_numpy()
        folded = fold_block(pdf["_s"].to_numpy(), pdf["_l"].to_numpy(), mine, int(pdf["idx"].iloc[0]), config, minimum)
        head = [pdf[k].iloc[0] for k in keys]
        row = [*head, int(pdf["_block"].iloc[0]), *[float(x) for x in folded], int(mine.sum())]
        return pd.DataFrame([row], columns=[*keys, "block", "a", "b", "lo", "hi", "n"])

    blocks = copies.groupBy(*keys, "_block").applyInPandas(
        run, f"{schema}, block bigint, a double, b double, lo double, hi double, n bigint"
    )
    ordered = blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("block", "a", "b", "lo", "hi"))).alias("_f"), F.sum("n").alias("n")
    )

    def apply(t: Column, f: Column) -> Column:
        return F.least(F.greatest(f["a"] * t + f["b"], f["lo"]), f["hi"])

    return ordered.select(*keys, "n", F.aggregate("_f", F.lit(config.base), apply).alias("threshold"))


def operator_stats(df: DataFrame, component: str, millis: str, score: str, flag: str, target: float = 200.0) -> DataFrame:
    """Per component: count, average, median and p95 time, average score, anomaly rate, target met."""
    basic = df.groupBy(component).agg(
        F.count("*").alias("n"), F.avg(millis).alias("avg_ms"), F.avg(score).alias("avg_score"),
        F.avg(F.col(flag).cast("int")).alias("anomaly_rate"),
    )
    tails = exact_percentiles(df, [component], F.col(millis), {"median_ms": 0.5, "p95_ms": 0.95})
    return basic.join(tails, component).withColumn("target_met", F.col("p95_ms") <= target)
