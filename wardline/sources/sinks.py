"""Event sinks: daily partitions, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.sources.schemas import daily_index

SERVICE = "wardline"


def enrich(events: DataFrame, ts: str = "ts", service: str = SERVICE) -> DataFrame:
    """Add @timestamp (now where missing), service, category and the day's index."""
    at = F.coalesce(F.col(ts).cast("timestamp"), F.current_timestamp())
    return events.withColumns(
        {
            "@timestamp": at,
            "service": F.lit(service),
            "event_category": F.lit("security"),
            "_index": daily_index("security-logs", at),
            "event_date": F.to_date(at),
        }
    )


def event_sink(events: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Write events into date partitions. Days come together before the write; Spark splits days that are large."""
    enrich(events, ts).hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def stream_event_sink(events: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """The same for a stream: exactly once through the file sink's log and the checkpoint."""
    return (
        enrich(events, ts).writeStream.format("parquet").partitionBy("event_date")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )


def route_sink(records: DataFrame, path: str, route: str = "route", mode: str = "append") -> None:
    records.write.mode(mode).partitionBy(route).parquet(path)
