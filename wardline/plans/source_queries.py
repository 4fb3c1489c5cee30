"""Queries that write tables out and read them back, and streams replayed from files."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from wardline.operators import evaluate as ev
from wardline.operators import events as ve
from wardline.operators import search_index as si
from wardline.plans.common import SQL_MIXED, load, mixed_prompts, rounded, section, sql_r6
from wardline.plans.dataset_queries import SQL_CONF, SQL_PRED, SQL_PRF, predictions, sql_metrics
from wardline.plans.event_queries import DAYS3, RULES, SQL_ALERTS, SQL_BRUTE
from wardline.plans.text_queries import coded_events
from wardline.sources import prompts as ps
from wardline.sources import schemas as sc
from wardline.sources import sinks as sk
from wardline.session import shared_folder
from wardline.streaming import detect as sd
from wardline.streaming import learn as sl

QUERIES, ORACLE, query = section()


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def samples(spark, sf):
    m = mixed_prompts(spark, sf)
    return m.select(
        F.col("text").alias("prompt"), F.col("truth").alias("label"), F.lit("mixed").alias("source"),
        F.when(F.col("truth") == 1, "opener").alias("attack_type"), F.when(F.col("truth") == 1, 0.5).alias("confidence"),
        F.create_map(F.lit("id"), F.col("prompt_id")).alias("metadata"),
    )


SQL_SAMPLES = f"""SELECT text AS prompt, truth AS label, 'mixed' AS source, CASE WHEN truth = 1 THEN 'opener' END AS attack_type,
    (CASE WHEN truth = 1 THEN 0.5 END)::DOUBLE AS confidence, prompt_id AS id FROM ({SQL_MIXED})"""


def flat(df):
    return df.select("prompt", "label", "source", "attack_type", "confidence", F.col("metadata")["id"].alias("id"))


@query("load_json", SQL_SAMPLES)
def load_json(spark, sf):
    """Files of one JSON array each, of about 1000 samples."""
    path = scratch(spark, "samples")
    fields = F.struct("prompt", "label", "source", "attack_type", "confidence", "metadata")
    rows = samples(spark, sf).select(F.xxhash64("prompt").alias("part"), fields.alias("s"))
    files = 1 + rows.count() // 1000
    arrays = rows.groupBy((F.pmod("part", F.lit(files))).alias("part")).agg(F.to_json(F.collect_list("s")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return flat(ps.load_json(spark, path))


@query("load_csv", SQL_SAMPLES)
def load_csv(spark, sf):
    path = scratch(spark, "samples")
    ps.save_csv(samples(spark, sf), path)
    return flat(ps.load_csv(spark, path))


@query(
    "load_text",
    """SELECT prompt, 0 AS label, part, line_number FROM (SELECT part, trim(replace(replace(line, chr(13), ' '), chr(9), ' ')) AS prompt,
      row_number() OVER (PARTITION BY part ORDER BY doc_id, i) AS line_number FROM (SELECT doc_id, doc_id // 200 AS part, unnest(lines) AS line, unnest(range(len(lines))) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))
    WHERE prompt <> ''""",
)
def load_text(spark, sf):
    """Files of 200 documents each, one after the other; every line with its number in the file."""
    path = scratch(spark, "lines")
    d = load(spark, sf, "documents").select("text", "doc_id", F.floor(F.col("doc_id") / 200).cast("long").alias("part"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").select("text", "part").write.partitionBy("part").text(path)
    lines = ps.load_text(spark, path, line_numbers=True)
    part = F.regexp_extract("source", r"/part=(\d+)/", 1).cast("long")
    return lines.select("prompt", "label", part.alias("part"), F.col("metadata")["line_number"].cast("long").alias("line_number"))


@query(
    "load_dataset",
    f"SELECT label, count(*)::BIGINT AS n, sum(length(prompt))::BIGINT AS chars FROM ({SQL_SAMPLES}) GROUP BY label",
)
def load_dataset(spark, sf):
    path = scratch(spark, "samples") + ".csv"
    ps.save_csv(samples(spark, sf), path)
    ps.load_dataset(spark, path, "mixed_samples")
    return spark.table("mixed_samples").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("chars"))


@query("save_evaluation", f"SELECT dataset, {sql_metrics(SQL_PRF)} FROM (SELECT dataset, {SQL_CONF} FROM ({SQL_PRED}) GROUP BY dataset)")
def save_evaluation(spark, sf):
    path = scratch(spark, "evaluations")
    ps.save_evaluation(rounded(ev.prf(predictions(spark, sf), ["dataset"]), *SQL_PRF), path)
    columns = ", ".join(f"{m} DOUBLE" for m in SQL_PRF)
    return spark.read.schema(f"dataset STRING, {columns}").json(path).select("dataset", *SQL_PRF)


@query(
    "event_sink",
    "SELECT 'security-logs-'||strftime(ts, '%Y.%m.%d') AS _index, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
)
def event_sink(spark, sf):
    path = scratch(spark, "event_log")
    sk.event_sink(load(spark, sf, "events"), path)
    return spark.read.parquet(path).groupBy("_index").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "bulk_write_report",
    """SELECT 'security-logs-'||strftime(ts, '%Y.%m.%d') AS _index, count(*) FILTER (WHERE value < 50)::BIGINT AS success,
    count(*) FILTER (WHERE value >= 50)::BIGINT AS errors FROM events GROUP BY 1""",
)
def bulk_write_report(spark, sf):
    return sc.bulk_write_report(load(spark, sf, "events"), sc.daily_index("security-logs", F.col("ts")), F.col("value") < 50)


@query(
    "typed_logs",
    """SELECT event_id, event_type AS metric_name, CASE WHEN event_id % 10 > 0 THEN value END AS metric_value, event_id % 10 = 0 AS corrupt,
    CASE WHEN event_id % 10 > 0 THEN props->>'$.k' END AS k FROM events""",
)
def typed_logs(spark, sf):
    """Metric records; every tenth one has text where the number belongs."""
    e = load(spark, sf, "events")
    bad = F.concat(F.lit('{"metric_name":"'), "event_type", F.lit('","metric_value":"n/a","tags":'), "props", F.lit("}"))
    good = F.concat(F.lit('{"metric_name":"'), "event_type", F.lit('","metric_value":'), F.col("value").cast("string"), F.lit(',"tags":'), "props", F.lit("}"))
    t = sc.typed_logs(e.select("event_id", "event_type", F.when(F.col("event_id") % 10 == 0, bad).otherwise(good).alias("json")), "json", sc.METRIC_LOG)
    ok = F.col(sc.CORRUPT).isNull()
    return t.select(
        "event_id", F.coalesce("metric_name", "event_type").alias("metric_name"), F.when(ok, F.col("metric_value")).alias("metric_value"),
        (~ok).alias("corrupt"), F.when(ok, F.col("tags")["k"]).alias("k"),
    )


SQL_MIXED_PROPS = """SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k":"'||(props->>'$.k')||'"}' WHEN 2 THEN '{"k":{"n":'||(props->>'$.k')||'}}'
    WHEN 3 THEN '{"k":['||(props->>'$.k')||',1.5]}' ELSE '{"k":' END AS json FROM events"""


def mixed_props(spark, sf):
    """The parameter k as number, text, object or list; every fifth text is cut off."""
    e = load(spark, sf, "events")
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    forms = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit('{"k":"'), k, F.lit('"}'))).when(i == 2, F.concat(F.lit('{"k":{"n":'), k, F.lit("}}")))
    return e.select("event_id", "event_type", forms.when(i == 3, F.concat(F.lit('{"k":['), k, F.lit(",1.5]}"))).otherwise('{"k":').alias("json"))


@query(
    "variant_logs",
    f"""SELECT event_id, CASE json_type(j, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'OBJECT' THEN 'OBJECT<n: BIGINT>' WHEN 'ARRAY' THEN 'ARRAY<DECIMAL>' END AS kind,
    CASE WHEN json_type(j, '$.k') IN ('UBIGINT', 'VARCHAR') THEN (j->>'$.k')::BIGINT END AS k, (j->>'$.k.n')::BIGINT AS nested, (j->>'$.k[0]')::BIGINT AS first, j IS NULL AS corrupt
    FROM (SELECT event_id, CASE WHEN json_valid(json) THEN json::JSON END AS j FROM ({SQL_MIXED_PROPS}))""",
)
def variant_logs(spark, sf):
    fields = {"k": ("$.k", "bigint"), "nested": ("$.k.n", "bigint"), "first": ("$.k[0]", "bigint"), "value": ("$.k", "variant")}
    t = sc.variant_logs(mixed_props(spark, sf), "json", fields)
    kind = F.regexp_replace(F.schema_of_variant("value"), r"ARRAY<.*>|DECIMAL\(.*", "ARRAY<DECIMAL>")
    return t.select("event_id", kind.alias("kind"), "k", "nested", "first", F.col(sc.CORRUPT).isNotNull().alias("corrupt"))


SEARCHED = "the license data privacy der pour"
SQL_WANTED = "['the', 'license', 'data', 'privacy', 'der', 'pour']"
SQL_STAMP = "TIMESTAMP '2024-01-01' + to_hours(doc_id % 700)"


@query(
    "search_ranked",
    f"""WITH d AS (SELECT doc_id, {SQL_STAMP} AS ts, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM documents),
    r AS (SELECT * FROM d WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26'),
    t AS (SELECT count(*) AS total, sum(len(words))/count(*)::DOUBLE AS average FROM r),
    p AS (SELECT doc_id, ts, len(words) AS length, word, len(list_filter(words, lambda x: x = word)) AS found FROM r, (SELECT unnest({SQL_WANTED}) AS word) WHERE list_contains(words, word)),
    f AS (SELECT word, count(*) AS n FROM p GROUP BY word)
    SELECT doc_id, ts, score FROM (SELECT doc_id, ts, round(sum(ln(1 + (total - n + 0.5)/(n + 0.5))*found*2.2/(found + 1.2*(0.25 + 0.75*length/average))), 6) AS score
      FROM p JOIN f USING (word), t WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-25 12:00:00' GROUP BY doc_id, ts)
    ORDER BY score DESC, doc_id LIMIT 100""",
)
def search_ranked(spark, sf):
    """Index all documents as messages of their hour, then the hundred best of three weeks."""
    import datetime as dt

    path = scratch(spark, "index")
    stamp = F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(hours=(F.col("doc_id") % 700).cast("int"))
    si.index_messages(load(spark, sf, "documents").select("doc_id", "text", stamp.alias("ts")), path, "text", "ts", "doc_id")
    found = si.search(spark, path, SEARCHED, dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 25, 12))
    return found.select(F.col("id").alias("doc_id"), "ts", "score")


# --- streams -----------------------------------------------------------------------------


SLICES = 6
LATE = "7 days"


def as_stream(spark, df, name: str, end: dict | None = None):
    """A table as a stream of files: slices of time one after the other, rows up to a day out of order, the files of a slice
    in any order. With `end` a row 90 days on comes last (with those values), so that the watermark passes all others."""
    path = scratch(spark, name)
    first, last = df.select(F.min("ts"), F.max("ts")).first()
    seconds = (last - first).total_seconds() + 86400
    moved = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first)) + F.pmod(F.xxhash64("event_id"), F.lit(86400))
    sliced = df.withColumn("_slice", F.least(F.floor(moved / F.lit(seconds) * SLICES), F.lit(SLICES - 1)).cast("int"))
    for i in range(SLICES):
        sliced.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
    if end is None:
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)
    closing = df.limit(1).select(*[(F.lit(last) + F.expr("INTERVAL 90 DAY") if c == "ts" else F.lit(end.get(c)).cast(t)).alias(c) for c, t in df.dtypes])
    closing.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def replay(stream, spark, name: str, mode: str = "append"):
    """Run a stream over all available files into a table and read it."""
    out = scratch(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", scratch(spark, name + "_checkpoint"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_brute_force", f"SELECT event_id, failed_attempts FROM ({SQL_BRUTE})")
def stream_brute_force(spark, sf):
    e = load(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = sd.stream_brute_force(as_stream(spark, e, "failures", {"user_id": -1}), "user_id", window_seconds=DAYS3, delay=LATE)
    return replay(found, spark, "brute").select("event_id", "failed_attempts")


@query(
    "stream_event_counts",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL",
)
def stream_event_counts(spark, sf):
    e = load(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return replay(sd.stream_event_counts(as_stream(spark, e, "events", {"event_type": "end"}), delay=LATE), spark, "counts")


@query("stream_event_pipeline", f"SELECT rule, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM ({SQL_ALERTS}) GROUP BY rule")
def stream_event_pipeline(spark, sf):
    from wardline.functions import text as tx

    e = coded_events(spark, sf)
    e = e.withColumn("category", tx.event_category(F.col("code"))).withColumnRenamed("code", "event_code")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "pipeline")
    q = sd.stream_event_pipeline(as_stream(spark, e, "coded", {"event_code": "end"}), out, scratch(spark, "pipeline_checkpoint"), ["event_id", "ts"], RULES)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/alerts").groupBy("rule").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("online_update")
def online_update(spark, sf):
    """Logistic regression that takes gradient steps on every batch of labelled events; its last version scores them all."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", k.alias("k"), (k + F.col("value") > 70).cast("int").alias("label"))
    features = ["value", "k"]
    spread = rows.agg(*[f(c).alias(f"{n}{c}") for c in features for n, f in (("m_", F.avg), ("s_", F.stddev_pop))]).first()
    centers = {c: (spread[f"m_{c}"], spread[f"s_{c}"]) for c in features}
    path = scratch(spark, "versions")
    sl.online_steps(as_stream(spark, rows, "labelled"), path, scratch(spark, "training_checkpoint"), features, "label", centers, 4.0, 5).trigger(availableNow=True).start().awaitTermination()
    weights = list(sl.version(spark, path)["weights"])
    p = 1.0 / (1.0 + F.exp(-sl.logit(features, centers, weights)))
    return rounded(rows.select("event_id", "label", (p > 0.5).alias("hit"), p.alias("probability")), "probability")
