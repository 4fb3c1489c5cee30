"""Queries with state: decisions with feedback, streams whose state is checked against the batch query, stored sketches."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from wardline.operators import feedback as fb
from wardline.operators import sketches as sk
from wardline.plans import fusion_queries as fq
from wardline.plans.common import load, rounded, section, sql_r6
from wardline.plans.event_queries import DAYS3, SQL_BRUTE
from wardline.plans.source_queries import LATE, as_stream, replay, scratch
from wardline.streaming import failures as fl
from wardline.streaming import thresholds as st

QUERIES, ORACLE, query = section()

# Every event once per number of hits that the decisions before it can have, with its verdict; then one decision per event type
# and step, from the list of the last hundred.
SQL_RANKED = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM ({fq.SQL_CLIPPED})"
SQL_HITS = f"SELECT *, CASE WHEN i >= 10 THEN h/least(i, 100)::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM (SELECT *, unnest(range(least(i, 100) + 1)) AS h FROM ({SQL_RANKED}))"
SQL_VERDICTS = fq.sql_decided(fq.sql_fused(fq.sql_adjusted(SQL_HITS, "k::DOUBLE", "rate", "hour(ts)"), "weighted_average", "event_id, event_type, i, h, rate"), "event_id, event_type, i, h, rate")


@query(
    "feedback_decisions",
    f"""WITH RECURSIVE v AS MATERIALIZED (SELECT event_type, i, any_value(event_id) AS event_id, list(is_anomalous ORDER BY h) AS verdicts, list(rate ORDER BY h) AS rates FROM ({SQL_VERDICTS}) GROUP BY event_type, i),
    d AS (SELECT event_type, -1::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS rate, NULL::BOOLEAN AS bad, []::INT[] AS seen FROM v WHERE i = 0
      UNION ALL SELECT event_type, i, event_id, rates[hits + 1], verdicts[hits + 1], list_append(CASE WHEN len(seen) = 100 THEN seen[2:] ELSE seen END, verdicts[hits + 1]::INT)
      FROM (SELECT v.*, d.seen, coalesce(list_sum(d.seen), 0)::BIGINT AS hits FROM d JOIN v ON v.event_type = d.event_type AND v.i = d.i + 1))
    SELECT event_id, {sql_r6('rate')} AS recent_rate, bad AS is_anomalous FROM d WHERE i >= 0""",
)
def feedback_decisions(spark, sf):
    """Every event decided with the rate of anomalous ones among the last 100 decisions of its type."""
    e = fq.clipped(spark, sf)
    decided = fb.detect_with_feedback(
        e, ["event_type"], ["ts", "event_id"], fq.cols(), fq.CONFIG, hour=F.hour("ts"), length=F.col("k").cast("double"), block=1024
    )
    return rounded(decided.select("event_id", "recent_rate", "is_anomalous"), "recent_rate")


@query("stream_thresholds", fq.ORACLE["threshold_adapter"])
def stream_thresholds(spark, sf):
    """The thresholds of the batch query from a replayed stream: the newest row of every type."""
    e = load(spark, sf, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"),
        (F.get_json_object("props", "$.k").cast("int") > 80).alias("label"),
    )
    moved = st.stream_thresholds(as_stream(spark, e, "observed", {"event_type": "end", "event_id": -1}), "event_type", "score", "label", config=fq.ADAPT, delay=LATE)
    newest = replay(moved, spark, "thresholds").groupBy(F.col("key").alias("event_type")).agg(F.max("n").alias("n"), F.max_by("threshold", "n").alias("threshold"))
    return rounded(newest, "threshold")


@query("brute_force_table", f"SELECT event_id, failed_attempts FROM ({SQL_BRUTE})")
def brute_force_table(spark, sf):
    """The batch query's events from a replayed stream whose state is a table."""
    e = load(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "failures")
    stream = as_stream(spark, e, "failures", {"user_id": -1, "event_id": -1})
    fl.brute_force_table(stream, path, scratch(spark, "failures_checkpoint"), "user_id", window_seconds=DAYS3, delay_seconds=7 * 86400).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/found").select("event_id", "failed_attempts")


SHARES = {"median": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "sketch_percentiles",
    f"""WITH s AS (SELECT event_type, CASE WHEN value > 1e-9 THEN ceil(ln(value)/{math.log(sk.growth(sk.ERROR))!r}::DOUBLE) END AS cell, value FROM events
      WHERE value >= 0 AND ts >= TIMESTAMP '2024-01-04 06:00:00' AND ts < TIMESTAMP '2024-01-24 18:00:00'),
    m AS (SELECT event_type, value, coalesce(2.0*pow({sk.growth(sk.ERROR)!r}::DOUBLE, cell)/{sk.growth(sk.ERROR) + 1.0!r}::DOUBLE, 0.0) AS middle FROM s)
    SELECT event_type, count(*)::BIGINT AS n, {sql_r6('avg(value)')} AS avg, {', '.join(f"{sql_r6(f'quantile_cont(middle, {q})')} AS {p}" for p, q in SHARES.items())} FROM m GROUP BY event_type""",
)
def sketch_percentiles(spark, sf):
    """Percentiles of twenty days and a half from the stored sketches of hours."""
    path = scratch(spark, "sketches")
    sk.store_sketches(load(spark, sf, "events"), path, ["event_type"], "ts", "value")
    window = sk.read_sketches(spark, path, dt.datetime(2024, 1, 4, 6), dt.datetime(2024, 1, 24, 18))
    p = sk.sketch_percentiles(window, ["event_type"], SHARES)
    return rounded(p.select("event_type", "n", "avg", *SHARES), "avg", *SHARES)
