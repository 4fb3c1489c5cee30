"""Adaptive thresholds on a stream: the recurrence of `fusion.adapt_thresholds`, row by row in event time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.operators.fusion import ThresholdConfig, percentile

STATE = "n bigint, threshold double, scores array<double>, labels array<boolean>, waiting binary, mark bigint"
#: An observation as it lies in a pack and in the state, and those packed or taken from it at once.
WAITING, STEP = np.dtype([("us", "<i8"), ("id", "<i8"), ("score", "<f8"), ("label", "?")]), 65_536
#: The time of rows without one.
NEVER = np.iinfo(np.int64).min


class Adapter:
    """Threshold of one key with its window of observations, kept in order of arrival and sorted by class."""

    def __init__(self, config: ThresholdConfig, minimum: int, n: int = 0, threshold: float | None = None, scores=(), labels=()):
        self.config, self.minimum, self.n = config, minimum, n
        self.threshold = config.base if threshold is None else threshold
        self.recent = deque(zip(scores, labels))
        self.by_class = {True: sorted(s for s, l in self.recent if l), False: sorted(s for s, l in self.recent if not l)}

    def observe(self, score: float, label: bool) -> None:
        c = self.config
        self.n += 1
        self.recent.append((score, label))
        insort(self.by_class[label], score)
        if len(self.recent) > c.window:
            old, was = self.recent.popleft()
            side = self.by_class[was]
            side.pop(bisect_left(side, old))
        pos, neg = self.by_class[True], self.by_class[False]
        if self.n >= self.minimum and pos and neg:
            best = (percentile(pos, c.percentile) + percentile(neg, 100.0 - c.percentile)) / 2.0
            self.threshold = min(c.high, max(c.low, (self.threshold + c.rate * (best - self.threshold)) * c.sensitivity))


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, us, packed) for each key of every STEP rows or so: the latest of their times, and the observations as WAITING rows."""

    def flushed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        named = pc.dictionary_encode(rows["key"], null_encoding="encode").combine_chunks()
        code, us = named.indices.to_numpy(), pc.fill_null(rows["us"], NEVER).to_numpy()
        whole = np.ones(len(code), bool)
        for name in WAITING.names:
            whole &= rows[name].is_valid().to_numpy()
        part = np.empty(len(code), WAITING)
        for name in WAITING.names:
            part[name] = pc.fill_null(rows[name], 0 if name != "label" else False).to_numpy()
        whole &= ~np.isnan(part["score"])
        latest = np.full(len(named.dictionary), NEVER)
        np.maximum.at(latest, code, us)
        ends = np.r_[0, np.cumsum(np.bincount(code[whole], minlength=len(latest)))] * WAITING.itemsize
        packed = part[whole][np.argsort(code[whole], kind="stable")].tobytes()
        return pa.RecordBatch.from_arrays(
            [named.dictionary, pa.array(latest, mask=latest == NEVER), pa.array([packed[a:z] for a, z in zip(ends, ends[1:])], pa.binary())], ["key", "us", "packed"]
        )

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= STEP:
            yield flushed()
            held, n = [], 0
    if n:
        yield flushed()


def stream_thresholds(
    observations: DataFrame, key: str, score: str, label: str, ts: str = "ts", id_col: str = "event_id",
    config: ThresholdConfig = ThresholdConfig(), minimum: int = 50, delay: str = "10 minutes",
) -> DataFrame:
    """Per key and trigger that moved it on: observations so far `n` and the `threshold` after them; the largest n is the newest.

    Observations wait until the watermark has passed them and are then taken in order of (event time, id), so files in any
    order give the thresholds of the batch query, as long as no row is later than `delay`; a row that comes after later ones of
    its key were taken is left out. Rows are packed by key before they are dealt (25 bytes an observation), because every 1024
    rows that a key is handed come with its whole state. State per key: the window of the last `config.window` observations,
    those that wait, packed as well, and the watermark up to which they were taken. Rows without a time, id, score or label
    only move the watermark; null keys are one key. Triggers that bring a key nothing give it no row.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, threshold, scores, labels, packed, taken = state.get if state.exists else (0, None, [], [], b"", None)
        adapter = Adapter(config, minimum, n, threshold, scores, labels)
        arrived = [] if state.hasTimedOut else [np.frombuffer(p, WAITING) for rows in batches for p in rows["packed"]]
        come = np.concatenate([np.empty(0, WAITING), *arrived])
        if taken is not None:
            come = come[come["us"] > taken * 1000]
        waiting = np.concatenate([np.frombuffer(packed, WAITING), come])
        del arrived, come
        waiting = waiting[np.lexsort([waiting[c] for c in reversed(WAITING.names)])]
        mark = state.getCurrentWatermarkMs()
        due = int(np.searchsorted(waiting["us"], mark * 1000, side="right"))
        for at in range(0, due, STEP):
            some = waiting[at : min(due, at + STEP)]
            for s, l in zip(some["score"].tolist(), some["label"].tolist()):
                adapter.observe(s, l)
        later = waiting[due:]
        kept = list(adapter.recent)
        state.update((adapter.n, adapter.threshold, [s for s, _ in kept], [bool(l) for _, l in kept], later.tobytes(), mark))
        if len(later):
            state.setTimeoutTimestamp(max(int(later["us"][0]) // 1000 + 1, mark + 1))
        if due:
            yield pd.DataFrame([(group[0], adapter.n, adapter.threshold)], columns=["key", "n", "threshold"])

    rows = observations.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(id_col).cast("long").alias("id"),
        F.col(score).cast("double").alias("score"), F.col(label).cast("boolean").alias("label"),
    )
    packed = rows.mapInArrow(packs, "key string, us long, packed binary")
    return packed.select("key", F.timestamp_micros("us").alias("ts"), "packed").withWatermark("ts", delay).groupBy("key").applyInPandasWithState(
        update, "key string, n bigint, threshold double", STATE, "append", GroupStateTimeout.EventTimeTimeout,
    )
