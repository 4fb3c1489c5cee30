"""Analysis plug-ins written in Python, with an error per row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Plugin = Callable[[pd.DataFrame], "pd.Series | np.ndarray | list"]
NO_RESULT = "no result"


def isolated(plugin: Plugin, rows: pd.DataFrame) -> list[tuple[float | None, str | None]]:
    """(result, error) per row. A batch that fails is halved until the rows that fail stand alone.

    One failing row among n costs about 2 log n calls, so a plug-in is called with whole batches as long as it works.
    """
    out: list = [(None, None)] * len(rows)
    spans = [(0, len(rows))] if len(rows) else []
    while spans:
        start, end = spans.pop()
        try:
            results = list(plugin(rows.iloc[start:end].reset_index(drop=True)))
            if len(results) != end - start:
                raise ValueError(f"{len(results)} results for {end - start} rows")
            out[start:end] = [(None, NO_RESULT) if pd.isna(r) else (float(r), None) for r in results]
        except Exception as error:  # whatever a plug-in raises belongs to its rows and stops no others
            if end - start == 1:
                out[start] = (None, f"{type(error).__name__}: {error}")
            else:
                middle = (start + end) // 2
                spans += [(start, middle), (middle, end)]
    return out


def python_plugins(df: DataFrame, plugins: dict[str, Plugin], inputs: list[str], out: str = "plugins") -> DataFrame:
    """Add `out`, a struct with (result, error) by plug-in name.

    A plug-in gets a pandas DataFrame of the input columns, one row per row, and gives as many numbers. It is called on Arrow
    batches; it must not rely on which rows share one. A row that makes it raise has the error's type and message, a null or NaN
    result is the error "no result", and all other rows of the batch keep their results. Every row stays, in all cases. Without
    plug-ins the DataFrame comes back as it is.
    """
    if not plugins:
        return df
    schema = StructType.fromDDL("result double, error string")

    def stage(plugin: Plugin):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            done = isolated(plugin, rows)
            return pd.DataFrame({"result": pd.Series([r for r, _ in done], dtype="float64"), "error": pd.Series([e for _, e in done], dtype="object")})

        run.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
        return F.pandas_udf(run, schema)

    given = F.struct(*[F.col(c) for c in inputs])
    scored = F.struct(*[stage(p)(given).alias(name) for name, p in plugins.items()])
    return df.withColumn(out, scored).withColumn(out, F.struct(*[blank_result(out, name).alias(name) for name in plugins]))


def blank_result(out: str, name: str):
    """A result that has an error is null, not the NaN that pandas makes of it."""
    part = F.col(out)[name]
    return F.struct(F.when(part["error"].isNull(), part["result"]).alias("result"), part["error"].alias("error"))
