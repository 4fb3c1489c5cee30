"""Ranked message search over stored postings.

The index is two tables partitioned by day: postings (word, id, times found, length of the message) sorted by word, and counts
(messages and their words per day, messages per word and day). A search reads the partitions of its days and, there, the row
groups of its words; the counts of a few words give the weights. Days are replaced as a whole, so indexing one again, or
retrying it, changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The usual constants of BM25.
SATURATION, LENGTH_WEIGHT = 1.2, 0.75
POSTINGS, COUNTS = "postings", "counts"


def message_words(message: Column) -> Column:
    """Words of a message, case folded: runs of letters and digits."""
    return F.filter(F.split(F.lower(message), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index_messages(messages: DataFrame, path: str, message: str, ts: str, id_col: str) -> None:
    """Write the postings and counts of all days in `messages`; a day that is there already is replaced.

    Rows without a time are left out, a null message has no words but counts as a message. Repeated rows are messages of their
    own with equal ids, whose scores add up to one hit.
    """
    timed = messages.where(F.col(ts).isNotNull()).select(
        F.to_date(ts).alias("day"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_col).alias("id"), F.sort_array(F.coalesce(message_words(F.col(message)), F.array())).alias("_words")
    )
    # Equal words stand together: a message's counts are the distances between the places where a word begins.
    begins = F.filter(F.sequence(F.lit(0), F.size("_words")), lambda i: ~F.get("_words", i).eqNullSafe(F.get("_words", i - 1)))
    counted = F.transform("_begins", lambda at, k: F.struct(F.get("_words", at).alias("word"), (F.get("_begins", k + 1) - at).cast("long").alias("found")))
    # A row per message without a word counts messages and their words, and a day whose messages have no words is replaced too.
    length = F.size("_words").cast("long")
    itself = F.array(F.struct(F.lit("").alias("word"), length.alias("found")))
    single = timed.withColumn("_begins", begins).select("day", "ts", "id", length.alias("length"), F.explode(F.concat(itself, counted)).alias("_c"))
    postings = single.select("day", "_c.word", "ts", "id", "_c.found", "length").where("found IS NOT NULL")
    # Large days are split, small ones share a task.
    overwrite(postings.hint("rebalance", "day").sortWithinPartitions("day", "word"), f"{path}/{POSTINGS}")
    stored = messages.sparkSession.read.parquet(f"{path}/{POSTINGS}").join(timed.select("day").distinct(), "day", "left_semi")
    found = stored.groupBy("day", "word").agg(F.count("*").alias("n"), F.sum("found").alias("words"))
    overwrite(found.repartition("day").sortWithinPartitions("day", "word"), f"{path}/{COUNTS}")


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the days that are in the table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def search(spark: SparkSession, path: str, query: str, start: dt.datetime | None = None, end: dt.datetime | None = None, limit: int = 100) -> DataFrame:
    """The best `limit` messages: id, ts and BM25 `score` to six digits; ties by id. A query without words finds nothing.

    Weights come from all messages of the days that the range touches; hits lie in [start, end).
    """
    wanted = sorted(set(spark.range(1).select(message_words(F.lit(query)).alias("w")).first()["w"]))

    def of_days(name: str) -> DataFrame:
        table = spark.read.parquet(f"{path}/{name}")
        if start is not None:
            table = table.where(F.col("day") >= F.lit(start.date()))
        if end is not None:
            table = table.where(F.col("day") <= F.lit((end - dt.timedelta(microseconds=1)).date()))
        return table

    counts = of_days(COUNTS).where(F.col("word").isin(["", *wanted])).groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    numbers = {r["word"]: r for r in counts.collect()}  # a row per word of the query
    hits = of_days(POSTINGS).where(F.col("word").isin(wanted))
    if start is not None:
        hits = hits.where(F.col("ts") >= F.lit(start))
    if end is not None:
        hits = hits.where(F.col("ts") < F.lit(end))
    total = numbers[""]["n"] if "" in numbers else 0
    average = numbers[""]["words"] / total if total and numbers[""]["words"] else 1.0
    weight = F.lit(0.0)
    for w in wanted:
        n = numbers[w]["n"] if w in numbers else 0
        weight = F.when(F.col("word") == w, F.log(F.lit(1.0 + (total - n + 0.5) / (n + 0.5)))).otherwise(weight)
    norm = SATURATION * (1.0 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("length") / average)
    part = weight * F.col("found") * (SATURATION + 1.0) / (F.col("found") + norm)
    scored = hits.groupBy("id", "ts").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id", "ts").limit(limit)
