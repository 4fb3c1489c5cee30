"""Ordered computations that stay parallel when one key holds much of the data.

A window over a key is one task per key. Here the rows of all keys are cut into
ranges of (keys, order) of about equal size, so a key with many rows is many
ranges, whatever its values: running totals come from the rows inside a range
plus the totals of the ranges before it. Frames of fixed length run per block of
a gap-free index, which gets the few earlier rows its frames reach back to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import checkpointed


def parted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows with `_part`, the number of their range of (keys, order).

    Spark cuts the ranges by sampled counts, as many as shuffle partitions. They are
    checkpointed, since a row must keep its range however often the result is read.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(ranges, *keys, *order).withColumn("_part", F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Add, by name, the sum of a column over the rows of the same key up to and with each row.

    `order` must be total within a key. Every window is bounded by a range; the
    offsets have one row per (range, key).
    """
    p = parted(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = p.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    starts = totals.select("_part", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    joined = null_safe_join(p.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}), starts, ["_part", *keys])
    return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_part", *[f"_o_{n}" for n in sums])


def running_index(df: DataFrame, keys: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """Exact 0-based position of each row within its key."""
    return running_totals(df, keys, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def over_blocks(
    df: DataFrame,
    keys: list[str],
    position: str,
    block: int,
    reach: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Run `compute(rows, partition_columns)` per (key, block of positions).

    A row is copied to every block that starts within `reach` positions after it
    and its result is kept once, in the block it belongs to.
    """
    own = F.floor(F.col(position) / F.lit(block)).cast("long")
    last = F.floor((F.col(position) + F.lit(reach)) / F.lit(block)).cast("long")
    copies = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.col("_own"), last)))
    return compute(copies, [*keys, "_block"]).where(F.col("_block") == F.col("_own")).drop("_own", "_block")


def lag_by_index(df: DataFrame, keys: list[str], idx: str, columns: dict[str, tuple[str, int]], block: int = 65536):
    """Add `out: (column, distance)` lags along a gap-free index."""
    reach = max(distance for _, distance in columns.values())

    def compute(rows: DataFrame, partition: list[str]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(idx)
        return rows.withColumns({out: F.lag(c, d).over(w) for out, (c, d) in columns.items()})

    return over_blocks(df, keys, idx, block, reach, compute)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`; a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_last")
    )
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def value_counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return (
        df.where(value.isNotNull())
        .groupBy(*[F.col(k) for k in keys], value.cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def cumulative_counts(vc: DataFrame, keys: list[str], sums: list[str], descending: bool = False) -> DataFrame:
    """Per distinct `value`: running totals `cum_<s>` of `sums`, this value included, and `total_<s>`."""
    order = F.col("value").desc() if descending else F.col("value").asc()
    running = running_totals(vc, keys, [order], {f"cum_{s}": F.col(s) for s in sums})
    whole = vc.groupBy(*keys).agg(*[F.sum(s).alias(f"total_{s}") for s in sums])
    if not keys:  # one row
        running, whole = running.withColumn("_k", F.lit(0)), whole.withColumn("_k", F.lit(0))
    joined = null_safe_join(running, whole, keys or ["_k"])
    return joined.select(*keys, "value", *sums, *[f"cum_{s}" for s in sums], *[f"total_{s}" for s in sums])


def at_percentiles(named: dict[str, float]) -> list[Column]:
    """Aggregates over `cumulative_counts` rows: linear-interpolated percentiles by name."""
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggs = []
    for name, p in named.items():
        h = F.lit(p) * (F.col("total_n") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        low = F.max(F.when((first <= lo) & (lo <= last), F.col("value")))
        high = F.max(F.when((first <= hi) & (hi <= last), F.col("value")))
        aggs.append((low + (high - low) * F.max(h - lo)).alias(name))
    return aggs


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, named: dict[str, float], count: str | None = None) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, without collecting a group; with the number of values as `count`.

    Distinct values are counted, ranks come from `cumulative_counts`, and only the
    values at the two neighbouring ranks of each percentile survive.
    """
    ranked = cumulative_counts(value_counts(df, keys, value), keys, ["n"])
    return ranked.groupBy(*keys).agg(*at_percentiles(named), *([F.sum("n").alias(count)] if count else []))


def rolling_sum(
    df: DataFrame, keys: list[str], idx: str, value: Column, last: int, out: str, skip_current: bool = False, block: int = 65536
) -> DataFrame:
    """Sum of `value` over the `last` rows up to each row (or before it), along a gap-free index.

    A difference of running sums inside a block, so the cost per row does not grow
    with `last`.
    """
    skip = 1 if skip_current else 0

    def compute(rows: DataFrame, partition: list[str]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(idx)
        running = rows.withColumn("_cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        upto = F.col("_cum") if not skip else F.coalesce(F.lag("_cum", skip).over(w), F.lit(0))
        return running.withColumn(out, upto - F.coalesce(F.lag("_cum", last + skip).over(w), F.lit(0))).drop("_cum")

    return over_blocks(df, keys, idx, block, last + skip, compute)


def trailing_count(df: DataFrame, keys: list[str], micros: str, window_micros: int, out: str) -> DataFrame:
    """Rows of the same key in the closed interval [t - window, t], t included with all its ties.

    Sweep line: the rows of a time enter at t and leave after t + window, and the
    running total of entries and exits is the count. Rows of one (key, t) collapse
    first; a burst of one key is cut into ranges like any other.
    """
    times = df.groupBy(*keys, F.col(micros).alias("_t")).agg(F.count("*").alias("_d"))
    enter = times.withColumn("_exit", F.lit(0))
    leave = times.select(*keys, (F.col("_t") + F.lit(window_micros)).alias("_t"), (-F.col("_d")).alias("_d"), F.lit(1).alias("_exit"))
    swept = running_totals(enter.unionByName(leave), keys, ["_t", "_exit"], {out: F.col("_d")}).where("_exit = 0")
    counts = swept.select(*keys, F.col("_t").alias(micros), out)
    return null_safe_join(df, counts, [*keys, micros])
