"""Queries over text features and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import severity as sv
from wardline.functions import text as tx
from wardline.operators.rows import position_rows
from wardline.plans.common import (
    SQL_MIXED, SQL_PROMPTS, hashed, load, mixed_prompts, prompts, quoted, r6, rounded, section,
    sql_contains_any,
    sql_hashed, sql_list, sql_matched, sql_r6, sql_words, words_of,
)

QUERIES, ORACLE, query = section()

W = sql_words("text")
PUNCT = "regexp_extract_all(text, '[.,!?;:]')"
UPPER = r"regexp_extract_all(text, '\p{Lu}')"
SPECIAL = r"regexp_extract_all(text, '[^\p{L}\p{N}\s\x{00A0}\x{3000}]')"
AVG_WORD = f"coalesce(list_sum(list_transform({W}, lambda w: length(w)))::DOUBLE / nullif(len({W}), 0), 0)"


def sql_ratio(part: str) -> str:
    return f"coalesce(len({part})::DOUBLE / nullif(length(text), 0), 0)"


@query(
    "tokenize",
    f"SELECT prompt_id, unnest({W}) AS token, unnest(range(len({W})))::BIGINT AS pos FROM ({SQL_PROMPTS})",
)
def tokenize(spark, sf):
    return position_rows(prompts(spark, sf), ["prompt_id"], tx.tokenize(F.col("text")), "token")


@query(
    "context_features",
    f"""SELECT prompt_id, length(text)::BIGINT AS prompt_length, len({W})::BIGINT AS word_count,
    {sql_r6(AVG_WORD)} AS avg_word_length, {sql_r6(sql_ratio(PUNCT))} AS punctuation_density,
    {sql_r6(sql_ratio(UPPER))} AS uppercase_ratio, {sql_r6(sql_ratio(SPECIAL))} AS special_char_ratio
    FROM ({SQL_PROMPTS})""",
)
def context_features(spark, sf):
    df = prompts(spark, sf).select("prompt_id", *[c.alias(n) for n, c in tx.context_features(F.col("text")).items()])
    return rounded(df, "avg_word_length", "punctuation_density", "uppercase_ratio", "special_char_ratio")


SQL_LINGUISTIC = f"""((len({W}) < 2 OR len({W}) > 100)::INT + ({sql_ratio(SPECIAL)} > 0.3)::INT
    + (len(list_distinct({W})) < len({W}) * 0.5 AND len({W}) > 5)::INT + ({sql_ratio(UPPER)} > 0.5)::INT) / 4.0"""


@query("linguistic_anomaly", f"SELECT doc_id, ({SQL_LINGUISTIC})::DOUBLE AS score FROM documents")
def linguistic_anomaly(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.linguistic_anomaly(F.col("text")).alias("score"))


SQL_NATURALNESS = f"""CASE WHEN len({W}) > 0 THEN (1.0/(1.0+abs({AVG_WORD}-5.0))
    + 1.0/(1.0+abs(len({W})::DOUBLE/len(string_split(text,'.'))-15.0)))/2.0 ELSE 0.0 END"""


@query("naturalness", f"SELECT doc_id, {sql_r6(SQL_NATURALNESS)} AS naturalness FROM documents")
def naturalness(spark, sf):
    return load(spark, sf, "documents").select("doc_id", r6(tx.naturalness(F.col("text"))).alias("naturalness"))


SQL_TOKEN_FREQUENCY = f"""coalesce(list_max(map_values(list_histogram({W})))::DOUBLE / nullif(len({W}), 0), 0)"""


@query(
    "token_frequency_anomaly",
    f"""WITH t AS (SELECT doc_id, unnest({W}) AS w FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL)
    SELECT d.doc_id, {sql_r6("coalesce(max(n)::DOUBLE/sum(n), 0)")} AS score
    FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
)
def token_frequency_anomaly(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", r6(tx.token_frequency_anomaly(words_of())).alias("score")
    )


@query(
    "sentences",
    """SELECT doc_id, unnest(string_split(text,'.')) AS sentence,
    unnest(range(len(string_split(text,'.'))))::BIGINT AS pos FROM documents""",
)
def sentences(spark, sf):
    return position_rows(load(spark, sf, "documents"), ["doc_id"], tx.sentences(F.col("text")), "sentence")


@query(
    "trigrams",
    f"""WITH w AS (SELECT prompt_id, {W} AS w FROM ({SQL_PROMPTS}))
    SELECT prompt_id, i::BIGINT AS pos, array_to_string(w[i+1:i+3], ' ') AS phrase
    FROM (SELECT prompt_id, w, unnest(range(len(w)-2)) AS i FROM w WHERE len(w) >= 3)""",
)
def trigrams(spark, sf):
    return position_rows(prompts(spark, sf), ["prompt_id"], tx.ngrams(words_of()), "phrase")


SQL_ATTACK = sql_contains_any("text", tx.ATTACK_PHRASES)
SQL_SUSPICIOUS = f"len({sql_matched('text', tx.SUSPICIOUS_WORDS)}) >= 2"
SQL_LABEL = f"""CASE WHEN {SQL_ATTACK} OR {SQL_SUSPICIOUS} THEN 1 ELSE 0 END AS label,
    CASE WHEN {SQL_ATTACK} THEN 'prompt_injection' WHEN {SQL_SUSPICIOUS} THEN 'suspicious_content' END AS attack_type,
    (CASE WHEN {SQL_ATTACK} THEN 0.8 WHEN {SQL_SUSPICIOUS} THEN 0.6 ELSE 0.9 END)::DOUBLE AS confidence"""


@query("auto_label", f"SELECT prompt_id, {SQL_LABEL} FROM ({SQL_MIXED})")
def auto_label(spark, sf):
    return mixed_prompts(spark, sf).select(
        "prompt_id", *[c.alias(n) for n, c in tx.auto_label(F.col("text")).items()]
    )


SQL_INJECTION = sql_matched("text", tx.INJECTION_PHRASES)


@query(
    "injection_patterns",
    f"""SELECT prompt_id, array_to_string({SQL_INJECTION}, '|') AS patterns, len({SQL_INJECTION})::BIGINT AS n,
    'MEDIUM' AS threat_level, substr(text, 1, 200) AS snippet
    FROM ({SQL_MIXED}) WHERE len({SQL_INJECTION}) > 0""",
)
def injection_patterns(spark, sf):
    found = mixed_prompts(spark, sf).withColumn("_p", tx.injection_patterns(F.col("text")))
    return found.where(F.size("_p") > 0).select(
        "prompt_id",
        F.array_join("_p", "|").alias("patterns"),
        F.size("_p").cast("long").alias("n"),
        tx.injection_threat(F.lit(0.8)).alias("threat_level"),
        F.substring("text", 1, 200).alias("snippet"),
    )


# Tool calls derived from events: the event type is the tool, props and a payload chosen by
# hash are the parameters, and value is the duration in seconds.
PAYLOADS = ["report.txt", "../../secret/file", "..\\up", "rm -rf /tmp/x", "SHUTDOWN now", "a UNION SELECT b", "x OR 1=1", "ok"]


def tool_calls(spark, sf):
    e = load(spark, sf, "events")
    choice = F.element_at(F.array(*[F.lit(p) for p in PAYLOADS]), hashed(F.col("event_id").cast("string"), len(PAYLOADS)) + 1)
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("tool"),
        F.create_map(F.lit("input"), choice, F.lit("props"), F.col("props")).alias("params"),
        F.col("value").alias("seconds"),
    )


SQL_PAYLOAD = f"{sql_list(PAYLOADS)}[{sql_hashed('event_id::VARCHAR', len(PAYLOADS))}+1]"


def sql_tool_findings(value: str, key: str) -> str:
    path = " OR ".join(f"contains({value}, {quoted(p)})" for p in tx.PATH_PATTERNS)
    return f"""[CASE WHEN {path} THEN 'Path traversal in {key}' END,
    CASE WHEN {sql_contains_any(value, tx.COMMAND_PATTERNS)} THEN 'Command injection in {key}' END,
    CASE WHEN {sql_contains_any(value, tx.SQL_PATTERNS)} THEN 'SQL injection in {key}' END]"""


SQL_TOOL_FINDINGS = f"""list_filter(list_concat({sql_tool_findings(SQL_PAYLOAD, 'input')}, {sql_tool_findings('props', 'props')},
    [CASE WHEN value > 30.0 THEN 'Unusually long execution time: '||value||'s' END]), lambda f: f IS NOT NULL)"""


@query(
    "tool_call_rules",
    f"""SELECT event_id, array_to_string({SQL_TOOL_FINDINGS}, '|') AS indicators FROM events
    WHERE len({SQL_TOOL_FINDINGS}) > 0""",
)
def tool_call_rules(spark, sf):
    found = tool_calls(spark, sf).withColumn("_f", tx.tool_call_indicators(F.col("params"), F.col("seconds")))
    return found.where(F.size("_f") > 0).select("event_id", F.array_join("_f", "|").alias("indicators"))


SQL_SECURITY = f"({sql_contains_any('text', tx.SECURITY_WORDS)} OR {sql_contains_any('source', tx.SECURITY_LOGGERS)})"


@query("security_log_filter", f"SELECT doc_id, source FROM documents WHERE {SQL_SECURITY}")
def security_log_filter(spark, sf):
    d = load(spark, sf, "documents")
    return d.where(tx.is_security_log(F.col("text"), F.col("source"))).select("doc_id", "source")


# Event codes of the event types of the events table, by position of a hash.
EVENT_CODES = [
    "auth.login.failure", "auth.login.success", "access.denied", "input.injection.attempt", "tool.call.anomaly",
    "prompt.anomaly", "system.service.failure", "data.exfiltration", "network.port.scan", "compliance.violation",
    "custom.event",
]
SQL_CODE = f"{sql_list(EVENT_CODES)}[{sql_hashed('event_id::VARCHAR', len(EVENT_CODES))}+1]"
SQL_CATEGORY = (
    "CASE " + " ".join(f"WHEN starts_with(code, '{p}') THEN '{c}'" for p, c in tx.EVENT_CATEGORIES)
    + " ELSE 'system_security' END"
)


def coded_events(spark, sf):
    """Events with a dotted code and a threat level 0..4 from the parameter k."""
    e = load(spark, sf, "events")
    codes = F.array(*[F.lit(c) for c in EVENT_CODES])
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.element_at(codes, hashed(F.col("event_id").cast("string"), len(EVENT_CODES)) + 1).alias("code"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("threat_level"),
    )


SQL_CODED = f"SELECT event_id, ts, user_id, event_type, value, props, {SQL_CODE} AS code, (props->>'$.k')::INT % 5 AS threat_level FROM events"


@query("event_category", f"SELECT event_id, code, {SQL_CATEGORY} AS category FROM ({SQL_CODED})")
def event_category(spark, sf):
    return coded_events(spark, sf).select("event_id", "code", tx.event_category(F.col("code")).alias("category"))


def scored_events(spark, sf):
    """Events with scores in 0..1 taken from value and the parameter k."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.least(F.col("value") / 100.0, F.lit(1.0)).alias("score"), (k / 100.0).alias("share"), k.alias("k"))


SQL_SCORED = """SELECT event_id, least(value/100.0, 1.0) AS score, (props->>'$.k')::INT/100.0::DOUBLE AS share,
    (props->>'$.k')::INT AS k FROM events"""


def sql_ladder(x: str, steps, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {b} THEN '{n}'" for b, n in steps) + f" ELSE '{default}' END"


LOW3 = [(0.8, "critical"), (0.6, "high"), (0.4, "medium")]
MID3 = [(0.9, "critical"), (0.7, "high"), (0.5, "medium")]


def _severity_query(name, fn, sql):
    @query(name, f"SELECT event_id, {sql} AS level FROM ({SQL_SCORED})")
    def run(spark, sf):
        return scored_events(spark, sf).select("event_id", fn(F.col("score")).alias("level"))


_severity_query("shift_severity", sv.shift_severity, sql_ladder("score", LOW3, "low"))
_severity_query("anomaly_severity", sv.anomaly_severity, sql_ladder("score", MID3, "low"))
_severity_query(
    "confidence_severity", sv.confidence_severity, sql_ladder("score", [(b, n.upper()) for b, n in MID3], "LOW")
)
SQL_RISK_LEVEL = """CASE WHEN score < 0.5 THEN 'low' WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high'
    ELSE 'medium' END"""
_severity_query("risk_level", sv.risk_level, SQL_RISK_LEVEL)


def sql_action(adv: str, risk: str, unc: str, soph: str) -> str:
    return f"""CASE WHEN NOT ({adv}) THEN 'allow' WHEN {risk} > 0.8 THEN 'block' WHEN {risk} > 0.6 THEN 'flag_for_review'
    WHEN {unc} > 0.7 THEN 'request_additional_analysis' WHEN {soph} > 0.7 THEN 'escalate_to_human_review'
    ELSE 'monitor' END"""


@query(
    "recommend_action",
    f"SELECT event_id, {sql_action('k % 4 > 0', 'score', 'share', '(1.0-share)')} AS action FROM ({SQL_SCORED})",
)
def recommend_action(spark, sf):
    e = scored_events(spark, sf)
    return e.select(
        "event_id",
        sv.recommend_action(F.col("k") % 4 > 0, F.col("score"), F.col("share"), 1.0 - F.col("share")).alias("action"),
    )


SQL_EXPLAIN = """WITH b AS (SELECT event_id, k, share, [{'name':'ESA','score':share},
      {'name':'CAP','score':((k*7)%100)/100.0::DOUBLE}, {'name':'STATISTICAL_ANOMALY','score':((k*13)%100)/100.0::DOUBLE},
      {'name':'ENSEMBLE_CLASSIFIER','score':((k*29)%100)/100.0::DOUBLE}] AS b FROM (@scored)),
    s AS (SELECT event_id, b, list_filter(b, lambda x: x.score > 0.5) AS hits, k FROM b),
    u AS (SELECT event_id, unnest(b) AS x FROM b),
    o AS (SELECT event_id, string_agg(x.name||'('||printf('%.2f', x.score)||')', ', ' ORDER BY x.score DESC, x.name) AS top
      FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY x.score DESC, x.name) AS rn FROM u) WHERE rn <= 3
      GROUP BY event_id)
    SELECT s.event_id, CASE WHEN len(hits) = 0 THEN 'No adversarial attacks detected.' ELSE
      'Detected '||len(hits)||' attack type(s): '||array_to_string(list_transform(hits, lambda x: x.name), ', ')
      ||'. Overall confidence: '||printf('%.2f', list_max(list_transform(hits, lambda x: x.score)))
      ||', uncertainty: '||printf('%.2f', k/100.0)||'. Top signals: '||top END AS explanation
    FROM s JOIN o USING (event_id)""".replace("@scored", SQL_SCORED)


@query("explanation", SQL_EXPLAIN)
def explanation(spark, sf):
    e = scored_events(spark, sf)
    parts = [("ESA", 1), ("CAP", 7), ("STATISTICAL_ANOMALY", 13), ("ENSEMBLE_CLASSIFIER", 29)]
    breakdown = F.array(
        *[F.struct(F.lit(n).alias("name"), ((F.col("k") * m) % 100 / 100.0).alias("score")) for n, m in parts]
    )
    b = e.withColumn("b", breakdown).withColumn("hits", F.filter("b", lambda x: x["score"] > 0.5))
    return b.select(
        "event_id",
        sv.explain_detections(
            F.transform("hits", lambda x: x["name"]),
            F.array_max(F.transform("hits", lambda x: x["score"])),
            F.col("share"),
            F.col("b"),
        ).alias("explanation"),
    )


@query("content_key", "SELECT doc_id, sha256('hashed-64:'||text) AS content_key FROM documents")
def content_key(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", tx.content_key(F.lit("hashed-64"), F.col("text")).alias("content_key")
    )


SQL_LEVEL_NAME = f"{sql_list(tx.THREAT_LEVELS)}[threat_level+1]"


@query(
    "event_json",
    f"""SELECT event_id, to_json({{'event_id':event_id,'event_type':code,'category':{SQL_CATEGORY},'threat_level':threat_level,
    'threat_level_name':{SQL_LEVEL_NAME},'user_id':user_id::VARCHAR,'value':value}})::VARCHAR AS event FROM ({SQL_CODED})""",
)
def event_json(spark, sf):
    e = coded_events(spark, sf)
    return e.select(
        "event_id",
        F.to_json(
            F.struct(
                "event_id", F.col("code").alias("event_type"), tx.event_category(F.col("code")).alias("category"),
                "threat_level", tx.threat_level_name(F.col("threat_level")).alias("threat_level_name"),
                F.col("user_id").cast("string").alias("user_id"), "value",
            )
        ).alias("event"),
    )


@query(
    "security_envelope",
    f"""SELECT event_id, CASE WHEN sev IN ('CRITICAL','ERROR','WARNING') THEN sev ELSE 'INFO' END AS log_level,
    'SECURITY EVENT: '||code AS message, to_json({{'event_type':code,'severity':sev,'user_id':user_id}})::VARCHAR AS envelope
    FROM (SELECT *, ['CRITICAL','ERROR','WARNING','HIGH','LOW'][threat_level+1] AS sev FROM ({SQL_CODED}))""",
)
def security_envelope(spark, sf):
    names = F.array(*[F.lit(s) for s in ["CRITICAL", "ERROR", "WARNING", "HIGH", "LOW"]])
    e = coded_events(spark, sf).withColumn("severity", F.element_at(names, F.col("threat_level") + 1))
    return e.select(
        "event_id",
        tx.log_level(F.col("severity")).alias("log_level"),
        F.concat(F.lit("SECURITY EVENT: "), "code").alias("message"),
        F.to_json(F.struct(F.col("code").alias("event_type"), "severity", "user_id")).alias("envelope"),
    )


@query(
    "enrich_context",
    """WITH r AS (SELECT conv_id, count(*) AS turns, min(turn) AS first_turn FROM conversations GROUP BY conv_id)
    SELECT conv_id||':'||turn AS prompt_id,
    'request='||c.conv_id||';'||'role='||c.role||';'||'turn='||c.turn||';'||'turns='||r.turns AS context
    FROM conversations c JOIN r USING (conv_id)""",
)
def enrich_context(spark, sf):
    c = load(spark, sf, "conversations")
    req = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn")).select(
        "conv_id",
        F.create_map(
            F.lit("request"), F.col("conv_id").cast("string"), F.lit("turns"), F.col("turns").cast("string"),
            F.lit("turn"), F.col("first_turn").cast("string"), F.lit("role"), F.lit("unknown"),
        ).alias("outer_context"),
    )
    local = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    joined = c.join(req, "conv_id", "left")
    return joined.select(
        F.concat_ws(":", "conv_id", "turn").alias("prompt_id"),
        tx.map_as_text(tx.merge_context(F.col("outer_context"), local)).alias("context"),
    )


FULLWIDTH_SQL = "translate(text, %s, %s)"


@query(
    "fullwidth_fold",
    f"""WITH wide AS (SELECT prompt_id, {FULLWIDTH_SQL % (quoted(''.join(map(chr, range(0x21, 0x7F))) + ' '),
    quoted(''.join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000)))} AS text FROM ({SQL_MIXED}))
    SELECT prompt_id, {FULLWIDTH_SQL % (quoted(''.join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000)),
    quoted(''.join(map(chr, range(0x21, 0x7F))) + ' '))} AS folded,
    ({SQL_ATTACK})::INT AS found_wide,
    ({sql_contains_any(FULLWIDTH_SQL % (quoted(''.join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000)),
    quoted(''.join(map(chr, range(0x21, 0x7F))) + ' ')), tx.ATTACK_PHRASES)})::INT AS found_folded FROM wide""",
)
def fullwidth_fold(spark, sf):
    plain, wide = "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000)
    evasive = mixed_prompts(spark, sf).withColumn("text", F.translate("text", plain, wide))
    folded = tx.fold_fullwidth(F.col("text"))
    return evasive.select(
        "prompt_id",
        folded.alias("folded"),
        tx.contains_any(F.col("text"), tx.ATTACK_PHRASES).cast("int").alias("found_wide"),
        tx.contains_any(folded, tx.ATTACK_PHRASES).cast("int").alias("found_folded"),
    )
