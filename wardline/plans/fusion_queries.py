"""Queries over signal fusion, thresholds, risk and the full prompt score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wardline.functions import text as tx
from wardline.operators import fusion as fu
from wardline.operators import plugins as pg
from wardline.operators import risk as rk
from wardline.operators.detectors import detect_attacks
from wardline.plans.common import SQL_MIXED, load, mixed_prompts, r6, rounded, section, sql_r6
from wardline.plans.detector_queries import ESA_SCALE, SQL_DETECTION_TEXT, SQL_FEATURES, featured
from wardline.plans.text_queries import SQL_LINGUISTIC, SQL_NATURALNESS, SQL_RISK_LEVEL
from wardline.plans.vector_queries import ANALYSIS, reference

QUERIES, ORACLE, query = section()

S = fu.SIGNALS
# With the default context weight of .3 every signal shrinks below every threshold, so the
# checked queries use 1; two signals are less reliable than the rest.
CONFIG = fu.FusionConfig(
    default_threshold=fu.ThresholdConfig(context_weight=1.0),
    reliability={"token_frequency": 0.5, "statistical_outlier": 0.75},
)
WEIGHT = {s: CONFIG.weight_of(s) for s in S}
REL = {s: CONFIG.reliability_of(s) for s in S}


def limit_of(signal: str, config: fu.FusionConfig = CONFIG) -> float:
    """The threshold as the number Spark computes, for use in SQL text."""
    c = config.threshold_of(signal)
    start = min(c.base * fu.LEVEL_FACTOR[config.level], c.high)
    return min(max(start * (fu.LEVEL_ADJUSTMENT[config.level] * (0.8 + 0.4 * config.reliability_of(signal))), c.low), c.high)


LIMIT = {s: limit_of(s) for s in S}


def signal_events(spark, sf):
    """Eight signals per event from the parameter k; some lie outside 0..1."""
    e = load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") + F.col("event_id").cast("int"))
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "k",
        *[((F.col("k") * (2 * i + 3)) % 131 / 100.0 - 0.1).alias(s) for i, s in enumerate(S)],
    )


SQL_SIGNALS = (
    "SELECT event_id, ts, user_id, event_type, value, k, "
    + ", ".join(f"((k*{2 * i + 3}) % 131)/100.0::DOUBLE - 0.1::DOUBLE AS {s}" for i, s in enumerate(S))
    + " FROM (SELECT *, (props->>'$.k')::INT + event_id::INT AS k FROM events)"
)


def sql_clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


SQL_CLIPPED = f"SELECT * REPLACE ({', '.join(f'{sql_clip(s)} AS {s}' for s in S)}) FROM ({SQL_SIGNALS})"


def clipped(spark, sf):
    raw = signal_events(spark, sf)
    return raw.withColumns(fu.clip_signals({s: F.col(s) for s in S}))


def cols():
    return {s: F.col(s) for s in S}


SQL_FEAT_SIGNALS = f"""SELECT prompt_id, text, 1.0 - mean_sim AS embedding_distance, semantic_consistency AS semantic_similarity,
    token_frequency_anomaly AS token_frequency, 1.0 - overall AS context_coherence, mean_g AS gradient_magnitude,
    embedding_outlier_score AS statistical_outlier, ({SQL_LINGUISTIC})::DOUBLE AS linguistic_pattern, conf AS ensemble_consensus,
    overall, attack_risk, attacks, {SQL_DETECTION_TEXT} AS said_text FROM feat"""


def signalled(spark, sf):
    return rk.with_signals(detect_attacks(featured(spark, sf), esa_scale=ESA_SCALE))


@query(
    "extract_signals",
    f"""WITH {SQL_FEATURES}, sig AS ({SQL_FEAT_SIGNALS}) SELECT prompt_id, signal, round(value, 6) + 0.0 AS value FROM
    (UNPIVOT (SELECT prompt_id, {', '.join(S)} FROM sig) ON {', '.join(S)} INTO NAME signal VALUE value)""",
)
def extract_signals(spark, sf):
    wide = signalled(spark, sf).select("prompt_id", "signals.*")
    return rounded(wide.unpivot("prompt_id", S, "signal", "value"), "value")


@query("clip_signals", f"SELECT event_id, {', '.join(f'{sql_r6(s)} AS {s}' for s in S)} FROM ({SQL_CLIPPED})")
def clip_signals(spark, sf):
    return rounded(clipped(spark, sf).select("event_id", *S), *S)


def sql_adjusted(source: str, length: str, rate: str, hour: str, config=CONFIG) -> str:
    """The source with its signals scaled by context."""
    factor = f"(least({length}/100.0, 1.5)*0.3 + (1.0+({rate}-0.1)*0.2)*0.4 + (CASE WHEN {hour} < 6 OR {hour} > 22 THEN 1.1 ELSE 1.0 END)*0.3)::DOUBLE"
    cells = ", ".join(f"{sql_clip(f'{s}*({factor}*{config.threshold_of(s).context_weight})')} AS {s}" for s in S)
    return f"SELECT * REPLACE ({cells}) FROM ({source})"


@query(
    "context_adjust",
    f"SELECT event_id, {', '.join(f'{sql_r6(s)} AS {s}' for s in S)} FROM ({sql_adjusted(SQL_CLIPPED, 'k::DOUBLE', '(value/397.0)', 'hour(ts)')})",
)
def context_adjust(spark, sf):
    e = clipped(spark, sf)
    a = fu.context_adjust(cols(), F.col("k").cast("double"), F.col("value") / 397.0, F.hour("ts"), CONFIG)
    return rounded(e.select("event_id", *[v.alias(s) for s, v in a.items()]), *S)


@query(
    "recent_anomaly_rate",
    f"""WITH o AS (SELECT event_id, event_type, (value > 20)::INT AS f, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
      avg((value > 20)::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS a FROM events)
    SELECT event_id, {sql_r6('CASE WHEN i >= 10 THEN a ELSE 0.0 END')} AS recent_rate FROM o""",
)
def recent_anomaly_rate(spark, sf):
    e = load(spark, sf, "events").select("event_id", "event_type", "ts", (F.col("value") > 20).alias("flag"))
    rated = fu.recent_anomaly_rate(e, ["event_type"], ["ts", "event_id"], "flag", block=1024)
    return rounded(rated.select("event_id", "recent_rate"), "recent_rate")


LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


@query(
    "level_thresholds",
    f"""SELECT event_id, level, round(least(greatest(least(base*f, 0.95)*(a*(0.8+0.4*rel)), 0.1), 0.95), 6) + 0.0 AS threshold FROM
    (SELECT event_id, {LEVELS}[k%4+1] AS level, [0.7,1.0,1.3,1.6][k%4+1]::DOUBLE AS f, [1.2,1.0,1.0,0.8][k%4+1]::DOUBLE AS a,
      (k%50)/50.0::DOUBLE AS rel, 0.3 + (k%7)/10.0::DOUBLE AS base FROM ({SQL_SIGNALS}))""",
)
def level_thresholds(spark, sf):
    e = signal_events(spark, sf)
    k = F.col("k")
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), k % 4 + 1)
    t = fu.level_threshold(0.3 + k % 7 / 10.0, level, k % 50 / 50.0)
    return e.select("event_id", level.alias("level"), r6(t).alias("threshold"))


def sql_contributions() -> tuple[str, str]:
    raw = {s: f"(CASE WHEN {s} > {LIMIT[s]!r} THEN ({s}-{LIMIT[s]!r})/(1.0-{LIMIT[s]!r}) ELSE 0.0 END * {WEIGHT[s] * REL[s]!r}::DOUBLE)" for s in S}
    return raw, "(" + "+".join(raw.values()) + ")"


RAW, RAW_TOTAL = sql_contributions()


@query(
    "contributions",
    f"""SELECT event_id, {', '.join(f"{sql_r6(f'CASE WHEN {RAW_TOTAL} > 0 THEN {RAW[s]}/{RAW_TOTAL} ELSE 0.0 END')} AS {s}" for s in S)}
    FROM ({SQL_CLIPPED})""",
)
def contributions(spark, sf):
    parts = fu.contributions(cols(), fu.level_thresholds(CONFIG), CONFIG)
    return rounded(clipped(spark, sf).select("event_id", *[v.alias(s) for s, v in parts.items()]), *S)


TOTAL_WEIGHT = sum(WEIGHT[s] * REL[s] for s in S)
SQL_FUSED = {
    "weighted_average": (
        "((" + "+".join(f"{s}*{WEIGHT[s] * REL[s]!r}::DOUBLE" for s in S) + f")/{TOTAL_WEIGHT!r}::DOUBLE)",
        "(" + "+".join(f"{LIMIT[s]!r}::DOUBLE*{WEIGHT[s]!r}::DOUBLE" for s in S) + ")",
        f"{min(TOTAL_WEIGHT, 1.0)!r}::DOUBLE",
    ),
    "majority_vote": (
        "((" + "+".join(f"({s} > {LIMIT[s]!r})::INT" for s in S) + ")/8.0::DOUBLE)",
        "0.6::DOUBLE",
        "(abs((" + "+".join(f"({s} > {LIMIT[s]!r})::INT" for s in S) + ")/8.0::DOUBLE - 0.5)*2.0)",
    ),
}
PRO = "(" + "+".join(f"greatest({s}-{LIMIT[s]!r}::DOUBLE, 0.0)*{REL[s]!r}::DOUBLE" for s in S) + ")"
CONTRA = "(" + "+".join(f"greatest({LIMIT[s]!r}::DOUBLE-{s}, 0.0)*{REL[s]!r}::DOUBLE" for s in S) + ")"
UNSURE = sum((1.0 - REL[s]) * 0.1 for s in S)
SQL_FUSED["evidence_fusion"] = (
    f"({PRO}/({PRO}+{CONTRA}+{UNSURE!r}::DOUBLE))", "0.5::DOUBLE", f"(1.0-{UNSURE!r}::DOUBLE/({PRO}+{CONTRA}+{UNSURE!r}::DOUBLE))",
)


def _fusion_query(name, method):
    score, limit, sure = SQL_FUSED[method]

    @query(name, f"SELECT event_id, {sql_r6(score)} AS score, {sql_r6(limit)} AS threshold, {sql_r6(sure)} AS confidence FROM ({SQL_CLIPPED})")
    def run(spark, sf):
        f = fu.METHODS[method](cols(), fu.level_thresholds(CONFIG), CONFIG)
        out = clipped(spark, sf).select("event_id", f.alias("f")).select("event_id", "f.*")
        return rounded(out, "score", "threshold", "confidence")


_fusion_query("fuse_weighted", "weighted_average")
_fusion_query("fuse_majority", "majority_vote")
_fusion_query("fuse_evidence", "evidence_fusion")


def sql_decided(fused_sql: str, keep: str) -> str:
    """From rows (keep, score, t, sure): effective score, decision and confidence."""
    return f"""SELECT {keep}, eff, eff > t AS is_anomalous, least(CASE WHEN eff > t THEN (eff-t)/(1.0-t) ELSE (t-eff)/t END, 1.0)*sure AS confidence
    FROM (SELECT *, CASE WHEN sure < 0.6 THEN score*(1.0-0.2) ELSE score END AS eff FROM ({fused_sql}))"""


def sql_fused(source: str, method: str, keep: str) -> str:
    score, limit, sure = SQL_FUSED[method]
    return f"SELECT {keep}, {score} AS score, {limit} AS t, {sure} AS sure FROM ({source})"


@query(
    "decide",
    f"""SELECT event_id, {sql_r6('eff')} AS effective_score, is_anomalous, {sql_r6('confidence')} AS anomaly_confidence
    FROM ({sql_decided(sql_fused(SQL_CLIPPED, 'evidence_fusion', 'event_id'), 'event_id')})""",
)
def decide(spark, sf):
    f = clipped(spark, sf).withColumn("_f", fu.fuse_evidence(cols(), fu.level_thresholds(CONFIG), CONFIG))
    d = fu.decide(F.col("_f"), CONFIG)
    return rounded(f.select("event_id", *[c.alias(n) for n, c in d.items()]), "effective_score", "anomaly_confidence")


@query(
    "normalize_weights",
    f"""SELECT lang, source, {sql_r6('w/sum(w) OVER (PARTITION BY lang)')} AS weight FROM
    (SELECT lang, source, sum(n_chars)::DOUBLE AS w FROM documents GROUP BY ALL)""",
)
def normalize_weights(spark, sf):
    w = load(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("weight"))
    return rounded(fu.normalize_weight_table(w, ["lang"], "weight"), "weight")


@query(
    "operator_stats",
    f"""SELECT event_type, count(*)::BIGINT AS n, {sql_r6('avg(value)')} AS avg_ms, {sql_r6('avg(k/100.0)')} AS avg_score,
    {sql_r6('avg((value > 20)::INT)')} AS anomaly_rate, {sql_r6('quantile_cont(value, 0.5)')} AS median_ms,
    {sql_r6('quantile_cont(value, 0.95)')} AS p95_ms, quantile_cont(value, 0.95) <= 200.0 AS target_met FROM ({SQL_SIGNALS}) GROUP BY event_type""",
)
def operator_stats(spark, sf):
    e = signal_events(spark, sf).select("event_type", "value", (F.col("k") / 100.0).alias("score"), (F.col("value") > 20).alias("flag"))
    st = fu.operator_stats(e, "event_type", "value", "score", "flag")
    return rounded(st, "avg_ms", "avg_score", "anomaly_rate", "median_ms", "p95_ms")


ADAPT = fu.ThresholdConfig()


@query(
    "threshold_adapter",
    f"""WITH e AS (SELECT event_type, ts, event_id, least(value/100.0, 1.0) AS score, (props->>'$.k')::INT > 80 AS label FROM events),
    w AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, quantile_cont(score, {ADAPT.percentile / 100}) FILTER (WHERE label) OVER r AS hi,
      quantile_cont(score, {1 - ADAPT.percentile / 100}) FILTER (WHERE NOT label) OVER r AS lo FROM e
      WINDOW r AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {ADAPT.window - 1} PRECEDING AND CURRENT ROW)),
    b AS (SELECT event_type, count(*)::BIGINT AS n, list((hi + lo)/2.0 ORDER BY i) FILTER (WHERE i >= 50 AND hi IS NOT NULL AND lo IS NOT NULL) AS best FROM w GROUP BY event_type)
    SELECT event_type, n, {sql_r6(f"list_reduce(list_prepend({ADAPT.base}::DOUBLE, coalesce(best, []::DOUBLE[])), lambda t, x: least(greatest((t + {ADAPT.rate}*(x - t))*{ADAPT.sensitivity}, {ADAPT.low}), {ADAPT.high}))")} AS threshold FROM b""",
)
def threshold_adapter(spark, sf):
    e = load(spark, sf, "events").select(
        "event_type", "ts", "event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"),
        (F.get_json_object("props", "$.k").cast("int") > 80).alias("label"),
    )
    return rounded(fu.adapt_thresholds(e, ["event_type"], ["ts", "event_id"], "score", "label", ADAPT), "threshold")


SQL_ANOMALY_DETECTION = sql_fused(
    sql_adjusted(f"SELECT * REPLACE ({', '.join(f'{sql_clip(s)} AS {s}' for s in S)}) FROM sig", "length(text)", "0.0", "12"),
    "weighted_average", "prompt_id, text, overall, attack_risk, attacks, said_text",
)


@query(
    "detect_anomalies",
    f"""WITH {SQL_FEATURES}, sig AS ({SQL_FEAT_SIGNALS}), fus AS ({SQL_ANOMALY_DETECTION})
    SELECT prompt_id, {sql_r6('score')} AS score, {sql_r6('t')} AS threshold, is_anomalous, {sql_r6('confidence')} AS confidence
    FROM ({sql_decided('SELECT * FROM fus', 'prompt_id, score, t')})""",
)
def detect_anomalies(spark, sf):
    d = fu.detect_anomalies(signalled(spark, sf), {s: F.col(f"signals.{s}") for s in S}, CONFIG)
    out = d.select(
        "prompt_id", F.col("fusion_score").alias("score"), F.col("fusion_threshold").alias("threshold"), "is_anomalous",
        F.col("anomaly_confidence").alias("confidence"),
    )
    return rounded(out, "score", "threshold", "confidence")


def _method_query(name: str, method: str):
    """The decision by another method on the signals of prompts."""
    other = replace(CONFIG, method=method)
    source = sql_fused(sql_adjusted(f"SELECT * REPLACE ({', '.join(f'{sql_clip(s)} AS {s}' for s in S)}) FROM sig", "length(text)", "0.0", "12"), method, "prompt_id")

    @query(
        name,
        f"""WITH {SQL_FEATURES}, sig AS ({SQL_FEAT_SIGNALS}), fus AS ({source})
        SELECT prompt_id, {sql_r6('score')} AS score, is_anomalous, {sql_r6('confidence')} AS confidence FROM ({sql_decided('SELECT * FROM fus', 'prompt_id, score, t')})""",
    )
    def run(spark, sf):
        d = fu.detect_anomalies(signalled(spark, sf), {s: F.col(f"signals.{s}") for s in S}, other)
        return rounded(d.select("prompt_id", F.col("fusion_score").alias("score"), "is_anomalous", F.col("anomaly_confidence").alias("confidence")), "score", "confidence")


_method_query("detect_by_majority", "majority_vote")
_method_query("detect_by_evidence", "evidence_fusion")


@query(
    "risk_aggregate",
    f"""SELECT event_id, {sql_r6('score')} AS risk_score, score >= 0.5 AS is_malicious, {SQL_RISK_LEVEL} AS risk_level, {sql_r6('two')} AS risk_without
    FROM (SELECT event_id, round(0.3*embedding_distance + 0.4*semantic_similarity + 0.3*token_frequency, 9) AS score,
      0.4*embedding_distance + 0.6*semantic_similarity AS two FROM ({SQL_CLIPPED}))""",
)
def risk_aggregate(spark, sf):
    e = clipped(spark, sf)
    three = rk.risk_aggregate(F.col(S[0]), F.col(S[1]), F.col(S[2]))
    two = rk.risk_aggregate(F.col(S[0]), F.col(S[1]))
    near = F.round(three["risk_score"], 9)
    return e.select(
        "event_id", r6(near).alias("risk_score"), (near >= 0.5).alias("is_malicious"),
        rk.sv.risk_level(near).alias("risk_level"), r6(two["risk_score"]).alias("risk_without"),
    )


@query(
    "prompt_risk",
    f"""WITH {SQL_FEATURES}, sig AS ({SQL_FEAT_SIGNALS}), fus AS ({SQL_ANOMALY_DETECTION}),
    dec AS ({sql_decided('SELECT * FROM fus', 'prompt_id, overall, attack_risk, attacks, said_text')}),
    risk AS (SELECT *, 0.3*overall + 0.4*attack_risk + 0.3*confidence AS score FROM dec)
    SELECT prompt_id, array_to_string(attacks, ',') AS attacks, {sql_r6('score')} AS risk_score, score >= 0.5 AS is_malicious,
    {SQL_RISK_LEVEL} AS risk_level, 'Risk '||printf('%.2f', round(score, 2))||'. '||said_text AS explanation FROM risk""",
)
def prompt_risk(spark, sf):
    d = rk.prompt_risk(mixed_prompts(spark, sf), reference(spark, sf), "prompt_id", ANALYSIS, CONFIG, ESA_SCALE)
    out = d.select("prompt_id", F.array_join("attacks", ",").alias("attacks"), "risk_score", "is_malicious", "risk_level", "explanation")
    return rounded(out, "risk_score")


@query("batch_score", f"SELECT prompt_id, risk_score, is_malicious, risk_level FROM ({ORACLE['prompt_risk']})")
def batch_score(spark, sf):
    """The full score, computed once per distinct text."""
    known = reference(spark, sf)

    def score(texts):
        scored = rk.prompt_risk(texts, known, "text_key", ANALYSIS, CONFIG, ESA_SCALE)
        return rounded(scored.select("text_key", "risk_score", "is_malicious", "risk_level"), "risk_score")

    columns = ["risk_score", "is_malicious", "risk_level"]
    return rk.batch_score(mixed_prompts(spark, sf).select("prompt_id", "text"), "text", score, columns).drop("text")


def _broken_plugin(df):
    raise ValueError("this plugin never works")


PLUGINS = {
    "naturalness": lambda df: tx.naturalness(F.col("text")),
    "label": lambda df: tx.auto_label(F.col("text"))["label"],
    "by_zero": lambda df: F.try_divide(F.lit(1.0), F.col("truth")),
    "broken": _broken_plugin,
}


@query(
    "plugin_scores",
    f"""SELECT prompt_id, {sql_r6(SQL_NATURALNESS)} AS naturalness, CASE WHEN truth = 1 THEN 1.0::DOUBLE END AS by_zero,
    CASE WHEN truth = 1 THEN NULL ELSE 'no result' END AS by_zero_error, 'ValueError' AS broken_error FROM ({SQL_MIXED})""",
)
def plugin_scores(spark, sf):
    d = rk.plugin_scores(mixed_prompts(spark, sf), PLUGINS)
    return d.select(
        "prompt_id", r6(F.col("plugins.naturalness.result")).alias("naturalness"), F.col("plugins.by_zero.result").alias("by_zero"),
        F.col("plugins.by_zero.error").alias("by_zero_error"), F.col("plugins.broken.error").alias("broken_error"),
    )


def _capitals(rows):
    """Share of capital letters; null for a null or empty text."""
    return rows["text"].str.count("[A-Z]") / rows["text"].str.len().where(lambda n: n > 0)


def _no_override(rows):
    """Refuses a batch with a text that speaks of an override."""
    if rows["text"].str.contains("override", case=False, regex=False).any():
        raise ValueError("override")
    return rows["text"].str.len()


@query(
    "python_plugins",
    f"""SELECT prompt_id, {sql_r6("CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE/length(text) END")} AS capitals,
    CASE WHEN NOT contains(lower(text), 'override') THEN length(text)::DOUBLE END AS chars, CASE WHEN contains(lower(text), 'override') THEN 'ValueError: override' END AS error FROM ({SQL_MIXED})""",
)
def python_plugins(spark, sf):
    """Two plug-ins on pandas rows; one fails on batches with an override, which costs only those rows their result."""
    d = pg.python_plugins(mixed_prompts(spark, sf), {"capitals": _capitals, "guard": _no_override}, ["text"])
    return d.select("prompt_id", r6(F.col("plugins.capitals.result")).alias("capitals"), F.col("plugins.guard.result").alias("chars"), F.col("plugins.guard.error").alias("error"))
