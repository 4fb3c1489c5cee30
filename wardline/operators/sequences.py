"""Statistics of ordered vector sequences: rows (sequence id, order, vector).

A sequence may hold any share of the table: neighbours come from blocks of the
running index, everything else from partial aggregates of one row per sequence
or per (sequence, dimension).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import vectors as vx
from wardline.operators.ordering import lag_by_index, running_index


def with_previous(df: DataFrame, seq: str, order: str, vec: str, span: int = 4096) -> DataFrame:
    """Add `prev_<vec>`: the vector before this one in its sequence; `order` is an integer unique per sequence."""
    indexed = running_index(df, [seq], [order])
    return lag_by_index(indexed, [seq], "idx", {f"prev_{vec}": (vec, 1)})


def step_lengths(df: DataFrame, seq: str, order: str, vec: str) -> DataFrame:
    """One row per adjacent pair: the L2 distance between neighbours."""
    pairs = with_previous(df, seq, order, vec).where(F.col(f"prev_{vec}").isNotNull())
    diff = F.zip_with(vec, f"prev_{vec}", lambda a, b: a.cast("double") - b.cast("double"))
    return pairs.select(seq, order, vx.l2_norm(diff).alias("step"))


def smoothness(df: DataFrame, seq: str, order: str, vec: str) -> DataFrame:
    """1 / (1 + mean step), 1 for sequences of one vector."""
    steps = step_lengths(df, seq, order, vec).groupBy(seq).agg(F.avg("step").alias("_mean"))
    every = df.groupBy(seq).agg(F.count("*").alias("n"))
    return every.join(steps, seq, "left").select(
        seq, "n", F.coalesce(1.0 / (1.0 + F.col("_mean")), F.lit(1.0)).alias("smoothness")
    )


def dimension_moments(df: DataFrame, seq: str, vec: str) -> DataFrame:
    """Per sequence and dimension: mean and population variance."""
    long = df.select(seq, F.posexplode(vec).alias("dim", "x"))
    return long.groupBy(seq, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"),
        F.var_pop(F.col("x").cast("double")).alias("var"),
        F.count("*").alias("n"),
    )


def perturbation_signature(df: DataFrame, seq: str, vec: str) -> DataFrame:
    """Uniformity of the per-dimension variance, 0 below three vectors."""
    return dimension_moments(df, seq, vec).groupBy(seq).agg(
        F.when(F.max("n") < 3, 0.0)
        .otherwise(vx.clip(1.0 - F.stddev_pop("var") / (F.avg("var") + 1e-8)))
        .alias("signature")
    )


def centroids(df: DataFrame, seq: str, vec: str) -> DataFrame:
    """Mean vector per sequence; the array has one entry per dimension."""
    means = dimension_moments(df, seq, vec).groupBy(seq).agg(
        F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("_m"), F.max("n").alias("n")
    )
    return means.select(seq, "n", F.transform("_m", lambda s: s["mean"]).alias("centroid"))


def outlier_score(df: DataFrame, seq: str, vec: str) -> DataFrame:
    """Largest |z| of the distances to the centroid, over 3, clipped to 0..1."""
    joined = df.join(centroids(df, seq, vec), seq)
    diff = F.zip_with(vec, "centroid", lambda a, b: a.cast("double") - b)
    dist = joined.select(seq, "n", vx.l2_norm(diff).alias("_d"))
    return dist.groupBy(seq).agg(
        outlier_from(F.max("n"), F.avg("_d"), F.stddev_pop("_d"), F.min("_d"), F.max("_d")).alias("outlier_score")
    )


def outlier_from(n: Column, mean: Column, std: Column, low: Column, high: Column) -> Column:
    """The z-score rule from the moments of the distances; a spread under 1e-6 counts as none."""
    spread = F.greatest(high - mean, mean - low)
    return F.when((n < 3) | (std < 1e-6), 0.0).otherwise(vx.clip(spread / std / 3.0))


def embedding_shift(
    df: DataFrame, seq: str, order: str, vec: str, scale: float = 10.0, threshold: float = 0.8
) -> DataFrame:
    """Embedding-shift detection over a vector sequence: one row per sequence."""
    steps = step_lengths(df, seq, order, vec)
    stats = steps.groupBy(seq).agg(
        F.avg("step").alias("mean_step"), F.stddev_pop("step").alias("_std"), F.max("step").alias("max_step")
    )
    far = steps.join(stats, seq).groupBy(seq).agg(
        F.first("mean_step").alias("mean_step"),
        F.first("max_step").alias("max_step"),
        F.count_if(F.col("step") > F.col("mean_step") + 2.0 * F.col("_std")).alias("num_perturbations"),
    )
    every = df.groupBy(seq).agg(F.count("*").alias("n")).join(far, seq, "left")
    size = F.coalesce(F.least(F.lit(1.0), F.col("max_step") / scale), F.lit(0.0))
    hit = size > (1.0 - threshold)
    return every.select(
        seq,
        "n",
        F.coalesce("mean_step", F.lit(0.0)).alias("mean_step"),
        F.coalesce("max_step", F.lit(0.0)).alias("max_step"),
        F.coalesce("num_perturbations", F.lit(0)).cast("long").alias("num_perturbations"),
        hit.alias("is_detected"),
        F.when(hit, size).otherwise(0.0).alias("confidence"),
    )
