"""Queries over security events: errors play failed logins, signups play successful ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import events as ve
from wardline.plans.common import SQL_MIXED, hashed, load, mixed_prompts, rounded, section, sql_contains_any, sql_hashed, sql_r6
from wardline.plans.generator_queries import sql_choice
from wardline.plans.text_queries import (
    SQL_CATEGORY, SQL_CODED, SQL_INJECTION, SQL_PAYLOAD, SQL_TOOL_FINDINGS, coded_events, tool_calls,
)

QUERIES, ORACLE, query = section()

# No user of the table fails five times within 300 s, so the checked queries look back three days.
DAYS3 = 3 * 86400
SQL_BRUTE = """SELECT * FROM (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW)::BIGINT AS failed_attempts
    FROM events WHERE event_type = 'error') WHERE failed_attempts >= 5"""


def failures(spark, sf):
    return load(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")


def brute(spark, sf):
    return ve.brute_force(failures(spark, sf), ["user_id"], window_seconds=DAYS3)


@query(
    "brute_force",
    f"""SELECT event_id, user_id, failed_attempts, 'Multiple failed login attempts detected from 10.0.0.'||(user_id % 20)||' for user '||user_id AS description,
    'brute-force,authentication' AS tags, 'T1110.001' AS technique FROM ({SQL_BRUTE})""",
)
def brute_force(spark, sf):
    b = brute(spark, sf).withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")))
    e = ve.brute_force_events(b, "ip", "user_id", DAYS3)
    return e.select(
        "event_id", "user_id", "failed_attempts", "description", F.array_join("tags", ",").alias("tags"),
        F.col("attack_vectors")[0]["technique"].alias("technique"),
    )


SQL_BLOCKED = f"""SELECT s.event_id, s.user_id, s.user_id % 20 AS source FROM events s JOIN
    (SELECT user_id % 20 AS source, min(ts) AS blocked_at FROM ({SQL_BRUTE}) GROUP BY 1) b ON s.user_id % 20 = b.source AND s.ts > b.blocked_at
    WHERE event_type = 'signup'"""


def success_after_block(spark, sf):
    blocked = ve.blocked_sources(brute(spark, sf).withColumn("source", F.col("user_id") % 20), "source")
    ok = load(spark, sf, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts", (F.col("user_id") % 20).alias("source"))
    return ve.blocked_success(ok, blocked, "source")


@query("blocked_source", SQL_BLOCKED)
def blocked_source(spark, sf):
    return success_after_block(spark, sf).select("event_id", "user_id", "source")


@query(
    "suspicious_success",
    f"""SELECT event_id, 2 AS threat_level, 'Successful login from IP '||source||' that was previously blocked for brute force' AS description,
    'suspicious-login,authentication' AS tags FROM ({SQL_BLOCKED})""",
)
def suspicious_success(spark, sf):
    e = ve.blocked_success_events(success_after_block(spark, sf), "source")
    return e.select("event_id", "threat_level", "description", F.array_join("tags", ",").alias("tags"))


@query(
    "injection_events",
    f"""SELECT prompt_id, 2 AS threat_level, 'Potential prompt injection detected with patterns: '||array_to_string(p, ', ') AS description,
    length(text)::BIGINT AS prompt_length, array_to_string([x||'@0.8' for x in p], '|') AS indicators, 'T1059' AS technique
    FROM (SELECT *, {SQL_INJECTION} AS p FROM ({SQL_MIXED})) WHERE len(p) > 0""",
)
def injection_events(spark, sf):
    e = ve.injection_events(mixed_prompts(spark, sf))
    shown = F.transform("indicators", lambda i: F.concat_ws("@", i["value"], i["confidence"].cast("string")))
    return e.select(
        "prompt_id", "threat_level", "description", F.col("prompt_length").cast("long").alias("prompt_length"),
        F.array_join(shown, "|").alias("indicators"), F.col("attack_vectors")[0]["technique"].alias("technique"),
    )


@query(
    "tool_call_events",
    f"""SELECT event_id, 'Suspicious Tool Call: '||event_type AS title, 'Anomalous tool call detected: '||array_to_string(f, ', ') AS description,
    3 AS threat_level, 'T1106' AS technique FROM (SELECT *, {SQL_TOOL_FINDINGS} AS f FROM events) WHERE len(f) > 0""",
)
def tool_call_events(spark, sf):
    e = ve.tool_call_events(tool_calls(spark, sf))
    return e.select("event_id", "title", "description", "threat_level", F.col("attack_vectors")[0]["technique"].alias("technique"))


# --- alerting ----------------------------------------------------------------------------

RULES = ve.DEFAULT_RULES + [
    ve.AlertRule("Failed Login Alert", ("log_alert", "block_ip"), 900, event_code="auth.login.failure"),
    ve.AlertRule("High Data Alert", ("notify",), 600, threat_level=3, category="data_protection"),
]


def sql_rule(rule: ve.AlertRule) -> str:
    tests = [f"{c} = {v!r}" for c, v in (("threat_level", rule.threat_level), ("code", rule.event_code), ("category", rule.category)) if v is not None]
    return " AND ".join(tests)


SQL_ALERTS = (
    "SELECT event_id, ts, r.rule, r.cooldown, r.actions FROM (SELECT event_id, ts, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {sql_rule(r)} THEN {{'rule': '{r.name}', 'cooldown': {r.cooldown}, 'actions': {list(r.actions)}}} END" for r in RULES)
    + f"], lambda x: x IS NOT NULL)) AS r FROM (SELECT *, {SQL_CATEGORY} AS category FROM ({SQL_CODED})))"
)


def alerts(spark, sf):
    e = coded_events(spark, sf)
    e = e.withColumn("category", tx.event_category(F.col("code"))).withColumnRenamed("code", "event_code")
    return ve.alert_match(e, ["event_id", "ts"], RULES)


@query("alert_match", f"SELECT event_id, rule FROM ({SQL_ALERTS})")
def alert_match(spark, sf):
    return alerts(spark, sf).select("event_id", "rule")


@query("alert_actions", f"SELECT event_id, rule, unnest(actions) AS action FROM ({SQL_ALERTS})")
def alert_actions(spark, sf):
    return ve.alert_actions(alerts(spark, sf), ["event_id", "rule"])


@query(
    "alert_cooldown",
    f"""SELECT rule, window_no AS window, event_id, n AS suppressed_and_sent FROM (SELECT rule, epoch_us(ts)//1000000//cooldown AS window_no, event_id,
    row_number() OVER (PARTITION BY rule, epoch_us(ts)//1000000//cooldown ORDER BY ts, event_id) AS r,
    count(*) OVER (PARTITION BY rule, epoch_us(ts)//1000000//cooldown)::BIGINT AS n FROM ({SQL_ALERTS})) WHERE r = 1""",
)
def alert_cooldown(spark, sf):
    return ve.alert_cooldown(alerts(spark, sf), "ts", "event_id").drop("ts")


@query(
    "event_statistics",
    f"""SELECT code AS event_code, threat_level, count(*)::BIGINT AS n, count(*) FILTER (WHERE threat_level >= 3)::BIGINT AS high_priority
    FROM ({SQL_CODED}) GROUP BY GROUPING SETS ((code), (threat_level), ())""",
)
def event_statistics(spark, sf):
    e = coded_events(spark, sf).withColumnRenamed("code", "event_code")
    return ve.event_statistics(e)


@query(
    "event_search",
    """SELECT event_id, event_type FROM events WHERE len(list_intersect(string_split_regex(lower(event_type||' by user '||user_id), '[^\\p{L}\\p{N}]+'), ['error', '42'])) > 0
    AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 100""",
)
def event_search(spark, sf):
    import datetime as dt

    e = load(spark, sf, "events").withColumn("message", F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")))
    found = ve.event_search(e, "message", "ts", "event_id", "Error 42", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))
    return found.select("event_id", "event_type")


SQL_LOGS = f"""SELECT doc_id, text AS message, source AS logger, ['DEBUG','INFO','WARNING','ERROR','CRITICAL'][{sql_hashed('doc_id::VARCHAR', 5)}+1] AS level,
    {sql_hashed('doc_id::VARCHAR', 5)}+1 AS rank FROM documents"""


def log_lines(spark, sf):
    levels = F.array(*[F.lit(x) for x in ve.LEVEL_ORDER])
    d = load(spark, sf, "documents")
    return d.select(
        "doc_id", F.col("text").alias("message"), F.col("source").alias("logger"),
        F.element_at(levels, hashed(F.col("doc_id").cast("string"), 5) + 1).alias("level"),
    )


SQL_SECURE = f"({sql_contains_any('message', tx.SECURITY_WORDS)} OR {sql_contains_any('logger', tx.SECURITY_LOGGERS)})"


@query(
    "log_routing",
    f"""SELECT doc_id, level, unnest(list_filter(['main', 'daily', CASE WHEN rank >= 3 AND {SQL_SECURE} THEN 'security' END, CASE WHEN rank >= 4 THEN 'errors' END],
    lambda x: x IS NOT NULL)) AS route FROM ({SQL_LOGS})""",
)
def log_routing(spark, sf):
    return ve.log_routing(log_lines(spark, sf), ["doc_id", "level"])


@query(
    "retention",
    """SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY
    OR (event_type = 'error' AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY)""",
)
def retention(spark, sf):
    import datetime as dt

    e = load(spark, sf, "events").withColumn("level", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"))
    return ve.retention(e, "ts", "level", dt.datetime(2024, 2, 1), days=10).select("event_id", "event_type")


@query("trace_sampling", f"SELECT event_id, user_id FROM events WHERE {sql_choice('user_id', '0', 1_000_000, 'trace')} < 100000")
def trace_sampling(spark, sf):
    return ve.trace_sampling(load(spark, sf, "events"), "user_id").select("event_id", "user_id")


@query(
    "operation_profile",
    f"""SELECT event_type, count(*)::BIGINT AS n, {sql_r6('avg(value)')} AS avg_ms, {sql_r6('quantile_cont(value, 0.5)')} AS median_ms,
    {sql_r6('quantile_cont(value, 0.95)')} AS p95_ms, {sql_r6('quantile_cont(value, 0.99)')} AS p99_ms, min(value) AS min_ms, max(value) AS max_ms
    FROM events GROUP BY event_type""",
)
def operation_profile(spark, sf):
    return rounded(ve.operation_profile(load(spark, sf, "events"), "event_type", "value"), "avg_ms", "median_ms", "p95_ms", "p99_ms")


@query(
    "trace_log_correlation",
    """SELECT e.event_id, md5('trace'||d.doc_id) AS trace_id, d.source AS operation, d.n_chars::DOUBLE AS duration_ms
    FROM events e LEFT JOIN documents d ON e.event_id % (SELECT count(*) FROM documents) = d.doc_id""",
)
def trace_log_correlation(spark, sf):
    """Events are log records that carry the ids of their span; documents are spans, as many events to each as there are."""
    def ids(key):
        k = key.cast("string")
        return F.md5(F.concat(F.lit("trace"), k)).alias("trace_id"), F.md5(F.concat(F.lit("span"), k)).alias("span_id")

    d, e = load(spark, sf, "documents"), load(spark, sf, "events")
    logs = e.select("event_id", F.col("value").alias("logged_ms"), *ids(F.col("event_id") % d.count()))
    spans = d.select(*ids(F.col("doc_id")), F.col("source").alias("operation"), F.col("n_chars").cast("double").alias("duration_ms"))
    return ve.trace_log_correlation(logs, spans).select("event_id", "trace_id", "operation", "duration_ms")


SQL_DRIFT_ROWS = "SELECT event_id, event_type, ts, ((props->>'$.k')::INT % 3 = 0 OR (value > 25 AND day(ts) > 20)) AS wrong FROM events"


@query(
    "drift_flag",
    f"""SELECT event_id, {sql_r6('rate')} AS error_rate, i >= 500 AND abs(rate - base) > 0.02 AS drift FROM
    (SELECT event_id, row_number() OVER w AS i, avg(wrong::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS rate,
      avg(wrong::INT) OVER (PARTITION BY event_type) AS base FROM ({SQL_DRIFT_ROWS}) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))""",
)
def drift_flag(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = load(spark, sf, "events")
    rows = e.select("event_id", "event_type", "ts", ((k % 3 == 0) | ((F.col("value") > 25) & (F.dayofmonth("ts") > 20))).alias("wrong"))
    d = ve.drift_flag(rows, ["event_type"], ["ts", "event_id"], "wrong", 500, 0.02, block=1024)
    return rounded(d.select("event_id", "error_rate", "drift"), "error_rate")


# --- tool-call patterns ------------------------------------------------------------------


@query(
    "rapid_fire",
    """SELECT user_id, epoch_us(ts)//3600000000 AS window, count(*)::BIGINT AS calls FROM events GROUP BY ALL HAVING count(*) >= 3""",
)
def rapid_fire(spark, sf):
    return ve.rapid_fire(load(spark, sf, "events"), "user_id", "ts", minimum=3, seconds=3600)


@query(
    "sequence_escalation",
    """WITH r AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS risk FROM events),
    l AS (SELECT *, lag(risk) OVER w AS one, lag(risk, 2) OVER w AS two FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id FROM l WHERE risk = 2 AND one = 1 AND two = 0""",
)
def sequence_escalation(spark, sf):
    t = F.col("event_type")
    calls = load(spark, sf, "events").withColumn(
        "risk", F.when(t == "view", 0).when(t == "click", 1).when(t == "purchase", 2).otherwise(-1)
    )
    found = ve.sequence_escalation(calls.select("event_id", "user_id", "ts", "risk"), "user_id", ["ts", "event_id"], "risk")
    return found.select("event_id", "user_id")


@query("parameter_overflow", "SELECT event_id, octet_length(props::BLOB)::INT AS payload_bytes FROM events WHERE octet_length(props::BLOB) > 8")
def parameter_overflow(spark, sf):
    return ve.parameter_overflow(load(spark, sf, "events"), "props", 8).select("event_id", "payload_bytes")


@query("off_hours", "SELECT event_id, hour(ts)::INT AS hour FROM events WHERE hour(ts) < 6 OR hour(ts) > 22")
def off_hours(spark, sf):
    return ve.off_hours(load(spark, sf, "events"), "ts").select("event_id", "hour")


@query(
    "add_indicator",
    f"""SELECT event_id, 'tool:'||event_type||'@0.8,user:'||user_id||'@1.0' AS indicators, 'T1106:HIGH,T9999:MEDIUM' AS vectors,
    CASE WHEN event_type = 'error' THEN 'tool-security,anomaly' ELSE 'tool-security,anomaly,'||event_type END AS tags
    FROM (SELECT *, {SQL_TOOL_FINDINGS} AS f FROM events) WHERE len(f) > 0""",
)
def add_indicator(spark, sf):
    e = ve.tool_call_events(tool_calls(spark, sf))
    user = ve.indicator("user", F.col("user_id").cast("string"))
    extra = ve.attack_vector("T9999", "Impact", "Follow-up")
    tagged = F.when(F.col("tool") == "error", ve.add_tag(F.col("tags"), "anomaly")).otherwise(F.array_union("tags", F.array("tool")))
    return e.select(
        "event_id",
        F.array_join(
            F.transform(ve.add_indicator(F.col("indicators"), user), lambda i: F.concat(i["type"], F.lit(":"), i["value"], F.lit("@"), i["confidence"].cast("string"))), ","
        ).alias("indicators"),
        F.array_join(
            F.transform(ve.add_attack_vector(F.col("attack_vectors"), extra), lambda v: F.concat_ws(":", v["technique"], v["severity"])), ","
        ).alias("vectors"),
        F.array_join(tagged, ",").alias("tags"),
    )
