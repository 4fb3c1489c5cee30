"""Decisions that depend on the decisions before them.

The signals of a row are scaled by the share of anomalous rows among the last 100 decisions of its key, so the rows of a key
form one long recurrence. It is cut into blocks of the running index. A row's verdict is first computed, in columns, for every
number of hits the rows before it can have: most rows have the same verdict for all of them. A block then starts with 100
unknown decisions and keeps, for every row, the least and the greatest number of hits that fit; where both give one verdict the
row is known, and after enough known rows the block has forgotten how it started. Only blocks that have rows left are run
again, with the last decisions of the block before them, once that block knows these.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import fusion as fu
from wardline.operators.ordering import null_safe_join, running_index
from wardline.session import checkpointed

UNKNOWN = "?"
#: Methods whose verdict can only turn from normal to anomalous as the rate rises.
RISING = ("weighted_average",)


def rate_of(hits: Column, idx: Column, last: int, minimum: int) -> Column:
    """Share of anomalous rows among the last ones, 0 for the first rows of a key."""
    return F.when(idx >= minimum, hits / F.least(idx, F.lit(last))).otherwise(0.0)


def verdict_by_rate(signals: dict[str, Column], config: fu.FusionConfig, length: Column, hour: Column) -> Callable[[Column], Column]:
    """Whether a row is anomalous, as a function of the recent anomaly rate; a row with a missing signal never is."""
    clipped = fu.clip_signals(signals)
    thresholds = fu.level_thresholds(config, list(signals))

    def verdict(rate: Column) -> Column:
        values = fu.context_adjust(clipped, length, rate, hour, config)
        return F.coalesce(fu.decide(fu.fuse(values, thresholds, config), config)["is_anomalous"], F.lit(False))

    whole = reduce(lambda a, b: a & b, [s.isNotNull() for s in signals.values()])
    return lambda rate: whole & verdict(rate)


def step_through(certain: np.ndarray, by_hits: list, first_idx: int, before: str, last: int, minimum: int):
    """Verdicts of a block's rows (1, 0, or -1 where the start decides), the hits before each row (or -1), and the last verdicts.

    `certain` holds 1 or 0, or -1 for rows whose verdict depends on the hits and stands in `by_hits`.
    """
    recent = deque({"1": 1, "0": 0, UNKNOWN: -1}[c] for c in before)
    ones, open_ = sum(r == 1 for r in recent), sum(r == -1 for r in recent)
    verdicts, hits = np.empty(len(certain), dtype=np.int8), np.empty(len(certain), dtype=np.int32)
    for k in range(len(certain)):
        v = int(certain[k])
        if v < 0:
            if first_idx + k < minimum:
                v = int(by_hits[k][0])
            else:
                fits = by_hits[k][ones : ones + open_ + 1]
                v = 1 if all(fits) else -1 if any(fits) else 0
        verdicts[k], hits[k] = v, -1 if open_ else ones
        recent.append(v)
        ones, open_ = ones + (v == 1), open_ + (v == -1)
        if len(recent) > last:
            old = recent.popleft()
            ones, open_ = ones - (old == 1), open_ - (old == -1)
    return verdicts, hits, "".join("01?"[r] for r in recent)


def feedback_decisions(
    df: DataFrame, keys: list[str], order: list[str], verdict: Callable[[Column], Column], rising: bool = False,
    last: int = 100, minimum: int = 10, block: int = 65536,
) -> DataFrame:
    """Keys, order, `recent_rate` and `is_anomalous` of every row, each decision made with the decisions before it.

    `verdict` maps a rate column to a boolean column and is evaluated for every possible number of hits; with `rising` only
    rows whose verdicts at rate 0 and 1 differ need that. `order` must be total within a key; null keys are one key. A block is
    one bounded task and must hold at least `last` rows. The number of rounds is one more than the longest row of blocks in
    which a block never forgets its start; only such blocks wait for each other.
    """
    if block < last:
        raise ValueError("a block must hold at least as many rows as are looked back on")
    indexed = running_index(df, keys, order)
    idx = F.col("idx")
    most = F.least(idx, F.lit(last))
    every = F.transform(F.sequence(F.lit(0), most.cast("int")), lambda h: F.coalesce(verdict(rate_of(h, idx, last, minimum)), F.lit(False)))
    at_0, at_1 = (F.coalesce(verdict(F.lit(r)), F.lit(False)) for r in (0.0, 1.0))
    same = at_0 == at_1
    by_hits = F.when(same & F.lit(rising), F.array(at_0)).otherwise(every)
    # A verdict that is the same for all hits is certain; the others keep their list.
    listed = indexed.withColumn("_every", by_hits).withColumn("_distinct", F.array_distinct("_every"))
    single = F.size("_distinct") == 1
    rows = listed.select(
        *keys, *order, "idx", F.floor(idx / block).cast("long").alias("_block"),
        F.when(single, F.col("_distinct")[0].cast("int")).otherwise(-1).alias("_certain"), F.when(~single, F.col("_every")).alias("_by_hits"),
    )
    rows = checkpointed(rows)
    columns = [*keys, *order]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first, before = int(pdf["idx"].iloc[0]), pdf["_before"].iloc[0]
        verdicts, hits, after = step_through(pdf["_certain"].to_numpy(), pdf["_by_hits"].tolist(), first, before, last, minimum)
        out = pdf[[*columns, "_block", "idx"]].copy()
        out["_hits"], out["_verdict"], out["_after"] = hits, verdicts, None
        out.iloc[-1, out.columns.get_loc("_after")] = after
        return out

    def borders(result: DataFrame) -> DataFrame:
        return result.where(F.col("_after").isNotNull() & ~F.contains("_after", F.lit(UNKNOWN))).select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_after").alias("_before"))

    pending = rows.withColumn("_before", F.when(F.col("_block") == 0, "").otherwise(UNKNOWN * last))
    settled, known, left = [], None, None
    while True:
        result = checkpointed(pending.groupBy(*keys, "_block").applyInPandas(run, f"{schema}, _block bigint, idx bigint, _hits int, _verdict int, _after string"))
        # A row whose hits are open has no rate yet, even if its verdict is certain.
        unsettled = result.groupBy(*keys, "_block").agg(F.max((F.col("_hits") < 0) | (F.col("_verdict") < 0)).alias("_open"))
        unsettled = unsettled.where("_open").drop("_open")
        fresh = borders(result)
        known = fresh if known is None else known.unionByName(fresh)
        ran = result.select(*keys, "_block").distinct()
        left = checkpointed(unsettled if left is None else null_safe_join(left, ran, [*keys, "_block"], "left_anti").unionByName(unsettled))
        settled.append(null_safe_join(result, unsettled, [*keys, "_block"], "left_anti"))
        if left.isEmpty():
            break
        ready = null_safe_join(left, known, [*keys, "_block"])
        pending = null_safe_join(rows, ready.select(*keys, "_block", "_before"), [*keys, "_block"])
    whole = reduce(DataFrame.unionByName, settled)
    rate = rate_of(F.col("_hits"), F.col("idx"), last, minimum)
    return whole.select(*columns, rate.alias("recent_rate"), (F.col("_verdict") == 1).alias("is_anomalous"))


def detect_with_feedback(
    df: DataFrame, keys: list[str], order: list[str], signals: dict[str, Column], config: fu.FusionConfig, text_col: str = "text",
    hour: Column | None = None, length: Column | None = None, block: int = 65536,
) -> DataFrame:
    """`feedback_decisions` of the fused signals; length in words of the text unless given, noon unless an hour is given."""
    size = tx.context_features(F.col(text_col))["prompt_length"] if length is None else length
    verdict = verdict_by_rate(signals, config, size, F.lit(12) if hour is None else hour)
    return feedback_decisions(df, keys, order, verdict, config.method in RISING, block=block)
