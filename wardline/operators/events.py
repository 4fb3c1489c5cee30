"""Security events: detection, alerting, search, routing and profiling on event tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators.evaluate import latency_profile
from wardline.operators.generate import choice
from wardline.operators.ordering import (
    lag_by_index, rolling_sum, running_index, trailing_count,
)
from wardline.operators.rows import fenced, inline_rows

# Brute-force window and threshold.
WINDOW_SECONDS, MIN_FAILURES = 300, 5


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def brute_force(
    failures: DataFrame, keys: list[str], ts: str = "ts", window_seconds: int = WINDOW_SECONDS,
    threshold: int = MIN_FAILURES,
) -> DataFrame:
    """Failed logins with at least `threshold` failures of the same key in the trailing window, itself included."""
    timed = failures.withColumn("_us", micros(F.col(ts)))
    counted = trailing_count(timed, keys, "_us", window_seconds * 1_000_000, "failed_attempts")
    return counted.where(F.col("failed_attempts") >= threshold).drop("_us")


def blocked_sources(brute: DataFrame, source: str, ts: str = "ts") -> DataFrame:
    """First time each source was blocked."""
    return brute.groupBy(source).agg(F.min(ts).alias("blocked_at"))


def blocked_success(successes: DataFrame, blocked: DataFrame, source: str, ts: str = "ts", block_ttl_seconds: int | None = None) -> DataFrame:
    """Successful logins after their source was blocked; without a ttl a block never ends."""
    joined = successes.join(blocked, source).where(F.col(ts) > F.col("blocked_at"))
    if block_ttl_seconds is not None:
        joined = joined.where(micros(F.col(ts)) <= micros(F.col("blocked_at")) + block_ttl_seconds * 1_000_000)
    return joined


def indicator(kind: Column | str, value: Column, confidence: float | Column = 1.0, description: str = "") -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), value.alias("value"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), F.lit(description).alias("description"),
    )


def attack_vector(technique: str, tactic: str, description: str, severity: str = "MEDIUM") -> Column:
    return F.struct(
        F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"), F.lit(description).alias("description"), F.lit(severity).alias("severity")
    )


def add_indicator(indicators: Column, new: Column) -> Column:
    return F.array_append(indicators, new)


def add_attack_vector(vectors: Column, new: Column) -> Column:
    return F.array_append(vectors, new)


def add_tag(tags: Column, tag: str) -> Column:
    """Tags are a set."""
    return F.array_union(tags, F.array(F.lit(tag)))


# Titles, descriptions, techniques and tags of the events below.


def brute_force_events(brute: DataFrame, source: str, user: str, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    src, usr = F.col(source).cast("string"), F.col(user).cast("string")
    return brute.withColumns(
        {
            "event_code": F.lit("auth.login.brute_force"),
            "category": F.lit("authentication"),
            "threat_level": F.lit(3),
            "title": F.lit("Brute Force Login Attack Detected"),
            "description": F.concat(F.lit("Multiple failed login attempts detected from "), src, F.lit(" for user "), usr),
            "blocked": F.lit(True),
            "time_window": F.lit(window_seconds),
            "indicators": F.array(indicator("ip", src, 0.9, "Brute force source IP"), indicator("username", usr, 0.8, "Targeted username")),
            "attack_vectors": F.array(attack_vector("T1110.001", "Credential Access", "Password Brute Force", "HIGH")),
            "tags": F.array(F.lit("brute-force"), F.lit("authentication")),
        }
    )


def blocked_success_events(success: DataFrame, source: str) -> DataFrame:
    src = F.col(source).cast("string")
    return success.withColumns(
        {
            "event_code": F.lit("auth.login.success"),
            "category": F.lit("authentication"),
            "threat_level": F.lit(2),
            "title": F.lit("Successful Login from Previously Blocked IP"),
            "description": F.concat(F.lit("Successful login from IP "), src, F.lit(" that was previously blocked for brute force")),
            "indicators": F.array(indicator("ip", src, 0.7, "Previously blocked IP")),
            "tags": F.array(F.lit("suspicious-login"), F.lit("authentication")),
        }
    )


def injection_events(df: DataFrame, text_col: str = "text", confidence: float = 0.8) -> DataFrame:
    """One event per prompt in which an injection phrase occurs."""
    found = fenced(df, {"patterns": tx.injection_patterns(F.col(text_col))}).where(F.size("patterns") > 0)
    level = 3 if confidence > 0.8 else 2
    return found.withColumns(
        {
            "event_code": F.lit("prompt.injection.detected"),
            "category": F.lit("prompt_security"),
            "threat_level": F.lit(level),
            "confidence": F.lit(confidence),
            "title": F.lit("Prompt Injection Attempt Detected"),
            "description": F.concat(F.lit("Potential prompt injection detected with patterns: "), F.array_join("patterns", ", ")),
            "blocked": F.lit(True),
            "snippet": F.substring(text_col, 1, 200),
            "prompt_length": F.length(text_col),
            "indicators": F.transform("patterns", lambda p: indicator("pattern", p, confidence, "Prompt injection pattern")),
            "attack_vectors": F.array(attack_vector("T1059", "Execution", "Command and Scripting Interpreter", "HIGH")),
            "tags": F.array(F.lit("prompt-injection"), F.lit("llm-security")),
        }
    )


def tool_call_events(df: DataFrame, tool: str = "tool", params: str = "params", seconds: str = "seconds") -> DataFrame:
    """One event per tool call with a suspicious parameter or duration."""
    found = fenced(df, {"findings": tx.tool_call_indicators(F.col(params), F.col(seconds))}).where(F.size("findings") > 0)
    return found.withColumns(
        {
            "event_code": F.lit("tool.call.anomaly"),
            "category": F.lit("tool_security"),
            "threat_level": F.lit(3),
            "title": F.concat(F.lit("Suspicious Tool Call: "), tool),
            "description": F.concat(F.lit("Anomalous tool call detected: "), F.array_join("findings", ", ")),
            "blocked": F.lit(True),
            "indicators": F.array(indicator("tool", F.col(tool), 0.8, "Suspicious tool usage")),
            "attack_vectors": F.array(attack_vector("T1106", "Execution", "Native API", "HIGH")),
            "tags": F.array(F.lit("tool-security"), F.lit("anomaly")),
        }
    )


# --- alerting ----------------------------------------------------------------------------


@dataclass(frozen=True)
class AlertRule:
    """Conditions that are None match everything; the others must all hold."""

    name: str
    actions: tuple[str, ...]
    cooldown: int
    threat_level: int | None = None
    event_code: str | None = None
    category: str | None = None
    extra: dict = field(default_factory=dict)


# The default rules.
DEFAULT_RULES = [
    AlertRule("Critical Threat Alert", ("log_alert", "send_notification"), 300, threat_level=4),
    AlertRule("High Threat Alert", ("log_alert",), 600, threat_level=3),
    AlertRule("Brute Force Alert", ("log_alert", "block_ip"), 900, event_code="auth.login.brute_force"),
]


def rule_condition(rule: AlertRule) -> Column:
    tests = [
        F.col(name) == value
        for name, value in (("threat_level", rule.threat_level), ("event_code", rule.event_code), ("category", rule.category))
        if value is not None
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def alert_match(events: DataFrame, keep: list[str], rules: list[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """One row per event and matching rule. Rules are configuration and become conditions of the scan's projection."""
    matches = F.array_compact(
        F.array(
            *[
                F.when(
                    rule_condition(r),
                    F.struct(
                        F.lit(r.name).alias("rule"), F.lit(r.cooldown).alias("cooldown"),
                        F.array(*[F.lit(a) for a in r.actions]).alias("actions"),
                    ),
                )
                for r in rules
            ]
        )
    )
    return inline_rows(events, keep, matches, "rule")


def alert_actions(alerts: DataFrame, keep: list[str]) -> DataFrame:
    return alerts.select(*keep, F.explode_outer("actions").alias("action")).where(F.col("action").isNotNull())


def alert_cooldown(alerts: DataFrame, ts: str, id_col: str) -> DataFrame:
    """The first alert of each rule in every tumbling window of its cooldown."""
    seconds = F.floor(micros(F.col(ts)) / 1_000_000)
    window = F.floor(seconds / F.col("cooldown")).cast("long")
    first = alerts.groupBy("rule", window.alias("window")).agg(
        F.min_by(F.struct(id_col, ts), F.struct(ts, id_col)).alias("_f"), F.count("*").alias("suppressed_and_sent")
    )
    return first.select("rule", "window", F.col("_f")[id_col].alias(id_col), F.col("_f")[ts].alias(ts), "suppressed_and_sent")


# --- reports -----------------------------------------------------------------------------


def event_statistics(events: DataFrame) -> DataFrame:
    """Counts by type, by threat level and in total, in one pass over grouping sets."""
    high = F.count_if(F.col("threat_level") >= 3).alias("high_priority")
    grouped = events.groupingSets(
        [["event_code"], ["threat_level"], []], "event_code", "threat_level"
    ).agg(F.count("*").alias("n"), high)
    return grouped


def event_search(
    events: DataFrame, message: str, ts: str, id_col: str, query: str | None = None, start=None, end=None, limit: int = 100
) -> DataFrame:
    """Newest events whose message has any of the query's words, in a time range; no query matches all."""
    found = events
    if query and query.split():
        # Words of the message, case folded: letters and digits.
        tokens = F.split(F.lower(message), r"[^\p{L}\p{N}]+")
        found = found.where(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in query.lower().split()])))
    if start is not None:
        found = found.where(F.col(ts) >= start)
    if end is not None:
        found = found.where(F.col(ts) < end)
    return found.orderBy(F.col(ts).desc(), F.col(id_col)).limit(limit)


LEVEL_ORDER = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), F.upper(level))


def log_routing(logs: DataFrame, keep: list[str], level: str = "level", message: str = "message", logger: str = "logger") -> DataFrame:
    """One row per record and destination: main and daily take all, security and errors what concerns them."""
    rank = level_rank(F.col(level))
    security = (rank >= 3) & tx.is_security_log(F.col(message), F.col(logger))
    routes = F.array_compact(
        F.array(F.lit("main"), F.lit("daily"), F.when(security, "security"), F.when(rank >= 4, "errors"))
    )
    return logs.select(*keep, F.explode_outer(routes).alias("route")).where(F.col("route").isNotNull())


def retention(logs: DataFrame, ts: str, level: str, now, days: int = 30) -> DataFrame:
    """Records young enough to keep; errors live twice as long. Plain comparisons, so they prune date partitions."""
    limit = F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    error_limit = F.lit(now) - F.expr(f"INTERVAL {2 * days} DAYS")
    is_error = level_rank(F.col(level)) >= 4
    return logs.where((F.col(ts) >= limit) | (is_error & (F.col(ts) >= error_limit)))


def trace_sampling(spans: DataFrame, trace_col: str, ratio: float = 0.1, seed: int = 0) -> DataFrame:
    """Whole traces kept by the hash of their id."""
    return spans.where(choice(F.col(trace_col), 0, 1_000_000, seed, "trace") < int(ratio * 1_000_000))


def operation_profile(spans: DataFrame, operation: str, millis: str) -> DataFrame:
    profile = latency_profile(spans, [operation], millis)
    return profile.select(operation, "n", "avg_ms", "median_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")


def trace_log_correlation(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Log records with the operation of their span, by trace and span id."""
    return logs.join(spans.select("trace_id", "span_id", "operation", "duration_ms"), ["trace_id", "span_id"], "left")


def drift_flag(
    df: DataFrame, keys: list[str], order: list[str], wrong: str, window: int = 1000, threshold: float = 0.1,
    block: int = 65536,
) -> DataFrame:
    """Rolling error rate of the last `window` rows against the key's overall rate."""
    indexed = running_index(df, keys, order)
    rolled = rolling_sum(indexed, keys, "idx", F.col(wrong).cast("int"), window, "_w", block=block)
    base = df.groupBy(*keys).agg(F.avg(F.col(wrong).cast("int")).alias("baseline"))
    joined = rolled.join(base, keys)
    rate = F.col("_w") / F.least(F.col("idx") + 1, F.lit(window))
    return joined.withColumn("error_rate", rate).withColumn(
        "drift", (F.col("idx") + 1 >= window) & (F.abs(F.col("error_rate") - F.col("baseline")) > threshold)
    ).drop("_w")


# --- tool-call patterns ------------------------------------------------------------------


def rapid_fire(calls: DataFrame, user: str, ts: str, minimum: int = 100, seconds: int = 1) -> DataFrame:
    """Users with at least `minimum` calls in a tumbling window; a partial aggregate per (user, window)."""
    window = F.floor(micros(F.col(ts)) / (seconds * 1_000_000)).cast("long")
    return calls.groupBy(user, window.alias("window")).agg(F.count("*").alias("calls")).where(F.col("calls") >= minimum)


def sequence_escalation(calls: DataFrame, user: str, order: list[str], risk: str) -> DataFrame:
    """Calls of risk 2 whose two predecessors of the same user had risk 0 and then 1."""
    indexed = running_index(calls, [user], order)
    lagged = lag_by_index(indexed, [user], "idx", {"_one": (risk, 1), "_two": (risk, 2)})
    return lagged.where((F.col(risk) == 2) & (F.col("_one") == 1) & (F.col("_two") == 0)).drop("_one", "_two", "idx")


def parameter_overflow(calls: DataFrame, payload: str, limit: int = 10 * 1024 * 1024) -> DataFrame:
    return calls.withColumn("payload_bytes", F.octet_length(payload)).where(F.col("payload_bytes") > limit)


def off_hours(calls: DataFrame, ts: str, start: int = 6, end: int = 22) -> DataFrame:
    """Calls before `start` or after `end` o'clock."""
    return calls.withColumn("hour", F.hour(ts)).where((F.col("hour") < start) | (F.col("hour") > end))
