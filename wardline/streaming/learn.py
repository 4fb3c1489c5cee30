"""Models that learn from a stream: one version per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "weights array<double>, rows long, loss double"


def first_version(spark: SparkSession, path: str, size: int) -> None:
    """Version -1: all weights zero (the last one is the bias)."""
    spark.createDataFrame([([0.0] * (size + 1), 0, 0.0)], VERSION).write.mode("overwrite").parquet(f"{path}/batch=-1")


def version(spark: SparkSession, path: str, before: int | None = None):
    """The newest version, or the newest one of the batches before a given one."""
    every = spark.read.schema(VERSION + ", batch long").parquet(path)
    return (every if before is None else every.where(F.col("batch") < before)).orderBy(F.desc("batch")).first()


def logit(features: list[str], centers: dict[str, tuple[float, float]], weights: list[float]) -> F.Column:
    terms = [F.lit(float(w)) * scaled(f, centers) for f, w in zip(features, weights)]
    return sum(terms, F.lit(float(weights[-1])))


def scaled(feature: str, centers: dict[str, tuple[float, float]]) -> F.Column:
    mean, spread = centers[feature]
    return (F.coalesce(F.col(feature).cast("double"), F.lit(float(mean))) - float(mean)) / float(spread or 1.0)


def step(batch: DataFrame, weights: list[float], features: list[str], label: str, centers: dict[str, tuple[float, float]], rate: float) -> tuple[list[float], int, float]:
    """One gradient step of logistic regression over a batch: sums in Spark, a handful of numbers back."""
    z = logit(features, centers, weights)
    p, y = 1.0 / (1.0 + F.exp(-z)), F.col(label).cast("double")
    ready = batch.where(F.col(label).isNotNull()).select(p.alias("_p"), y.alias("_y"), *[scaled(f, centers).alias(f"_x{i}") for i, f in enumerate(features)])
    wrong, right = F.col("_p") - F.col("_y"), F.when(F.col("_y") == 1, F.col("_p")).otherwise(1.0 - F.col("_p"))
    sums = ready.agg(F.count("*").alias("n"), F.sum(-F.ln(F.greatest(right, F.lit(1e-15)))).alias("loss"), F.sum(wrong).alias("b"), *[F.sum(wrong * F.col(f"_x{i}")).alias(f"g{i}") for i in range(len(features))]).first()
    if not sums["n"]:
        return list(weights), 0, 0.0
    slopes = [*(sums[f"g{i}"] for i in range(len(features))), sums["b"]]
    return [w - rate * g / sums["n"] for w, g in zip(weights, slopes)], sums["n"], sums["loss"] / sums["n"]


def online_steps(samples: DataFrame, path: str, checkpoint: str, features: list[str], label: str, centers: dict[str, tuple[float, float]], rate: float = 1.0, steps: int = 1):
    """`steps` gradient steps for every micro-batch, from the weights of the batch before.

    A version lies in a folder named by its batch and is made from the newest version of an earlier batch, so a batch that is
    delivered again makes the same version again. Batches without labelled rows carry the weights on. Features are scaled by
    `centers` (mean and spread by feature); null features count as the mean.
    """
    first_version(samples.sparkSession, path, len(features))

    def handle(batch: DataFrame, batch_id: int) -> None:
        take(batch, batch_id, path, features, label, centers, rate, steps)

    return samples.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def take(batch: DataFrame, batch_id: int, path: str, features: list[str], label: str, centers: dict[str, tuple[float, float]], rate: float, steps: int) -> None:
    """Write the version of one batch."""
    kept = batch.persist()
    try:
        weights, n, loss = list(version(batch.sparkSession, path, batch_id)["weights"]), 0, 0.0
        for _ in range(steps):
            weights, n, loss = step(kept, weights, features, label, centers, rate)
        batch.sparkSession.createDataFrame([(weights, n, loss)], VERSION).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    finally:
        kept.unpersist()
