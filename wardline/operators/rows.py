"""Array columns to rows.

The outer generators are used with a null check on what they produce: for the
inner ones the optimizer derives a filter on the array's size, pushes it below the
projections that build the array, and so computes the whole array a second time,
with all intermediate columns inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(df: DataFrame, keep: list[str], structs: Column | str, mark: str) -> DataFrame:
    """One row per struct of the array, with its fields as columns; `mark` is a field that is never null."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(mark).isNotNull())


def position_rows(df: DataFrame, keep: list[str], array: Column | str, value: str, pos: str = "pos") -> DataFrame:
    """One row per element with its 0-based position."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("long"))


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters use without recomputing them.

    A filter on a plain computed column is pushed below the projection and brings
    the whole expression along; it cannot pass a generator.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(made)))
