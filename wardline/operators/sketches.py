"""Percentiles from stored sketches.

A sketch counts values by cells whose borders grow by a constant factor, so the middle of a cell is within `error` of every value
in it, relative to the value. Counts of cells add up: sketches of hours, tables and days merge by a sum, and a percentile of any
window is read from a few thousand counts, never from the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ordering import at_percentiles, cumulative_counts

ERROR = 0.01
#: Values below this are counted as zero.
SMALLEST = 1e-9


def growth(error: float) -> float:
    return (1.0 + error) / (1.0 - error)


def cell_of(value: Column, error: float) -> Column:
    """Number of a value's cell; null for what is no duration: null, NaN, infinite and negative values; zero has no number."""
    valid = (value >= 0) & ~F.isnan(value) & (value < float("inf"))
    return F.when(valid & (value > SMALLEST), F.ceil(F.log(value) / math.log(growth(error))).cast("int"))


def middle_of(cell: Column, error: float) -> Column:
    g = growth(error)
    return F.when(cell.isNull(), 0.0).otherwise(2.0 * F.pow(F.lit(g), cell.cast("double")) / (g + 1.0))


def sketch_table(df: DataFrame, keys: list[str], ts: str, value: str, error: float = ERROR) -> DataFrame:
    """One row per (keys, hour, cell): `n` values and their sum `total`. Rows without a time or a valid value are left out.

    A partial aggregate: a hot key is as many rows as it has cells before the shuffle.
    """
    v = F.col(value).cast("double")
    valid = F.col(ts).isNotNull() & (v >= 0) & ~F.isnan(v) & (v < float("inf"))
    cells = df.where(valid).select(*keys, F.date_trunc("hour", ts).alias("hour"), cell_of(v, error).alias("cell"), v.alias("_v"))
    return cells.groupBy(*keys, "hour", "cell").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def store_sketches(df: DataFrame, path: str, keys: list[str], ts: str, value: str, error: float = ERROR) -> None:
    """Write the sketches by day; the days in `df` replace what was there, so a day may be delivered again."""
    table = sketch_table(df, keys, ts, value, error).withColumn("day", F.to_date("hour")).repartition("day")
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_sketches(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The sketches of the hours in [start, end); whole days outside are not read."""
    table = spark.read.parquet(path)
    if start is not None:
        table = table.where((F.col("day") >= F.to_date(F.lit(start))) & (F.col("hour") >= F.lit(start)))
    if end is not None:
        table = table.where((F.col("day") <= F.to_date(F.lit(end))) & (F.col("hour") < F.lit(end)))
    return table


def sketch_percentiles(table: DataFrame, keys: list[str], named: dict[str, float], error: float = ERROR) -> DataFrame:
    """Per key: count `n`, exact mean `avg`, and for every name its percentile with the bounds `<name>_low` and `<name>_high`
    between which the exact interpolated percentile lies.

    `table` may be any union of sketches made with the same `error`. Null keys are one key; a key without values has no row.
    """
    merged = table.groupBy(*keys, middle_of(F.col("cell"), error).alias("value")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    ranked = cumulative_counts(merged, keys, ["n", "total"])
    found = ranked.groupBy(*keys).agg(F.max("total_n").alias("n"), (F.max("total_total") / F.max("total_n")).alias("avg"), *at_percentiles(named))
    bounds = {}
    for name in named:
        bounds[f"{name}_low"] = F.greatest(F.col(name) / (1.0 + error) - SMALLEST, F.lit(0.0))
        bounds[f"{name}_high"] = F.col(name) / (1.0 - error) + SMALLEST
    return found.withColumns(bounds)
