"""Brute force on a stream whose state is a table, for keys too hot for one state row.

`detect.stream_brute_force` keeps the waiting rows of a key in one row of Python state. Here the rows that still matter are a
table, each micro-batch is a Spark job over it, and the count within the window is the batch operator's sweep over ranges of
(key, time): a key with half of all rows is as many tasks as any others of that size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.events import MIN_FAILURES, WINDOW_SECONDS, brute_force

ROWS = "event_id bigint, key string, ts timestamp, told boolean"
MARK = "batch bigint, mark timestamp"


def version(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame, object]:
    """The rows and the mark after a batch, if that batch was finished; nothing before the first."""
    side = batch_id % 2
    try:
        last = spark.read.schema(MARK).parquet(f"{path}/mark/side={side}").where(F.col("batch") == batch_id).first()
    except Exception as error:  # only a folder that is not there means that nothing came before
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    if last is None:
        if batch_id >= 0:
            raise ValueError(f"batch {batch_id} was never finished in {path}")
        return spark.createDataFrame([], ROWS), None
    return spark.read.schema(ROWS).parquet(f"{path}/rows/side={side}"), last["mark"]


def sweep(batch: DataFrame, batch_id: int, path: str, window_seconds: int, threshold: int, delay_seconds: int) -> None:
    """Write the events that this batch makes final, the rows that later ones need, and the new mark, in this order.

    Two sides take turns, so the state read is never the state written and only two versions exist. A batch that is delivered
    again reads the version before it again and writes the same folders.
    """
    spark = batch.sparkSession
    before, mark = version(spark, path, batch_id - 1)
    fresh = batch.where(F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    if mark is not None:
        fresh = fresh.where(F.col("ts") > F.lit(mark))
    every = before.unionByName(fresh.withColumn("told", F.lit(False))).persist()
    try:
        newest = every.agg((F.max("ts") - F.make_dt_interval(secs=F.lit(delay_seconds))).alias("m")).first()["m"]
        mark = max((m for m in (mark, newest) if m is not None), default=None)
        due = F.col("ts") <= F.lit(mark).cast("timestamp")
        found = brute_force(every.where(due), ["key"], "ts", window_seconds, threshold).where(~F.col("told"))
        found.select("event_id", "key", "ts", "failed_attempts").write.mode("overwrite").parquet(f"{path}/found/batch={batch_id}")
        needed = F.col("ts") > F.lit(mark).cast("timestamp") - F.make_dt_interval(secs=F.lit(window_seconds))
        kept = every.where(needed).withColumn("told", F.col("told") | due)
        kept.write.mode("overwrite").parquet(f"{path}/rows/side={batch_id % 2}")
        spark.createDataFrame([(batch_id, mark)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}/mark/side={batch_id % 2}")
    finally:
        every.unpersist()


def brute_force_table(
    failures: DataFrame, path: str, checkpoint: str, key: str, ts: str = "ts", id_col: str = "event_id",
    window_seconds: int = WINDOW_SECONDS, threshold: int = MIN_FAILURES, delay_seconds: int = 600,
):
    """A stream of failed logins into `path`/found: the events of the batch query, each once.

    An event is final when a row `delay_seconds` newer has come; rows older than that are late and left out, as are rows
    without a time or id. Null keys are one key. Ties and repeated rows count as rows. `path` must be new or belong to the
    same checkpoint; the state holds the rows of one window and one delay.
    """
    rows = failures.select(F.col(id_col).cast("long").alias("event_id"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        sweep(batch, batch_id, path, window_seconds, threshold, delay_seconds)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
