"""Structured Streaming detectors: brute force, counters and the event pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.operators.events import MIN_FAILURES, WINDOW_SECONDS, alert_match
from wardline.sources.sinks import enrich


def stream_brute_force(
    failures: DataFrame, key: str, ts: str = "ts", id_col: str = "event_id", window_seconds: int = WINDOW_SECONDS,
    threshold: int = MIN_FAILURES, delay: str = "10 minutes", parts: int = 256,
) -> DataFrame:
    """Brute force on a stream of failed logins, the same events as the batch query.

    Rows wait until the watermark has passed them and are then swept in event time, so a row that arrives late but within
    `delay` counts where it belongs; rows without a time never count. Keys are dealt into `parts` by their hash, and a part is
    swept at once, because a call of the state function costs more than many keys. State per part: the waiting rows, and
    (key, time, count) of the last window. `parts` is fixed for the life of a stream.
    """
    window = window_seconds * 1_000_000

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, waiting = (pd.DataFrame(dict(zip(names, v))) for names, v in zip((SEEN, WAITING), halves(state.get if state.exists else [[]] * 6)))
        arrived = [] if state.hasTimedOut else [rows[WAITING] for rows in batches]
        waiting = typed(pd.concat([waiting, *arrived], ignore_index=True))
        now = state.getCurrentWatermarkMs()
        due = waiting["us"] <= now * 1000
        later, (out, seen) = waiting[~due], sweep(typed(seen), waiting[due], window, threshold)
        seen = seen[seen["us"] + window > now * 1000]
        if len(later) or len(seen):
            state.update(tuple(plain(rows[c]) for rows, names in ((seen, SEEN), (later, WAITING)) for c in names))
            wake = later["us"].min() if len(later) else seen["us"].max() + window
            state.setTimeoutTimestamp(max(int(wake) // 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        yield out

    timed = failures.select(
        F.col(id_col).cast("long").alias("event_id"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")
    ).where("ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts))).withWatermark("ts", delay)
    return timed.groupBy("_part").applyInPandasWithState(
        update, "event_id bigint, key string, us bigint, failed_attempts bigint",
        "seen_keys array<string>, times array<bigint>, counts array<bigint>, keys array<string>, waiting array<bigint>, ids array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


SEEN, WAITING = ["key", "us", "n"], ["key", "us", "event_id"]


def halves(state) -> tuple:
    return state[:3], state[3:]


def plain(column: pd.Series) -> list:
    """Values as the state takes them."""
    gone = column.isna()
    return [None if g else x for x, g in zip(column.tolist(), gone)] if gone.any() else column.tolist()


def typed(rows: pd.DataFrame) -> pd.DataFrame:
    kinds = {"key": object, "us": "int64", "n": "int64", "event_id": "Int64"}
    return rows.astype({c: kinds[c] for c in rows.columns})


def sweep(seen: pd.DataFrame, due: pd.DataFrame, window: int, threshold: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The due rows whose key has at least `threshold` rows in the window that ends with them, `seen` (key, time, count) among
    them; and (key, time, count) of both that lie in the window of their key's last row."""
    if not len(due):
        return pd.DataFrame({"event_id": due["event_id"], "key": due["key"], "us": due["us"], "failed_attempts": due["us"]}), seen
    code, keys = pd.factorize(np.concatenate([seen["key"].to_numpy(object), due["key"].to_numpy(object)]), use_na_sentinel=False)
    us = np.concatenate([seen["us"], due["us"]])
    # Ranks of the times and of the windows' beginnings: (key, rank) fits one number.
    ranks, at = np.unique(np.concatenate([us, us - window]), return_inverse=True)
    place, begin = code * len(ranks) + at[: len(us)], code * len(ranks) + at[len(us) :]
    moments, first, own = np.unique(place, return_index=True, return_inverse=True)
    counts = np.bincount(own, np.concatenate([seen["n"], np.ones(len(due))])).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(counts)])
    inside = sums[1:] - sums[np.searchsorted(moments, begin[first])]
    got = inside[own[len(seen) :]]
    out = due.assign(failed_attempts=got)[["event_id", "key", "us", "failed_attempts"]][got >= threshold]
    who, when = code[first], us[first]
    last = when[np.searchsorted(who, who, side="right") - 1]
    kept = when >= last - window
    return out, pd.DataFrame({"key": np.array(keys, object)[who][kept], "us": when[kept], "n": counts[kept]})


def stream_event_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per type and hour; a window is final once the watermark passes its end."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counted = timed.groupBy(F.window("_ts", window).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def stream_alert_cooldown(alerts: DataFrame, ts: str, cooldown: str) -> DataFrame:
    """First alert per rule; repeats within the cooldown of event time are dropped."""
    return alerts.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", cooldown).dropDuplicatesWithinWatermark(["rule"]).drop("_ts")


def stream_event_pipeline(
    events: DataFrame, path: str, checkpoint: str, keep: list[str], rules, processors: list[Callable[[DataFrame, int], None]] = (),
):
    """Queue to sink to rules to processors, per micro-batch.

    Each batch writes into its own folder and replaces it on a retry, so a batch
    that runs twice is stored once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            enrich(kept).write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
            alert_match(kept, keep, rules).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
            for processor in processors:
                processor(kept, batch_id)
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def online_update(samples: DataFrame, table: str, checkpoint: str, refit: Callable[[DataFrame], None], ts: str = "ts", window_days: int = 30):
    """Append each labelled batch to the training table and refit on its last window.

    The table has a folder per batch and day; only the newest day is read for the newest time, only the days of the window
    for the fit.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", F.to_date(ts))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{table}/batch={batch_id}")
        every = spark.read.parquet(table)
        last = every.select("day").agg(F.max("day").alias("d")).first()["d"]
        newest = every.where(F.col("day") == F.lit(last)).agg(F.max(ts).alias("m")).first()["m"]
        span = F.expr(f"INTERVAL {window_days} DAY")
        recent = every.where((F.col("day") >= F.to_date(F.lit(newest) - span)) & (F.col(ts) >= F.lit(newest) - span))
        refit(recent.drop("batch", "day"))

    return samples.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
