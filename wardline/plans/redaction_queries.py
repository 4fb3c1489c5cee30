"""Queries over redaction of log text and records.

Log lines are the documents, every one followed by a secret or personal datum built from
its doc_id, so that each rule finds something in a table that has few of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import redact as rd
from wardline.functions import text as tx
from wardline.plans.common import hashed, load, section, sql_contains_any, sql_hashed, sql_list

QUERIES, ORACLE, query = section()

# '#' stands for the doc_id, padded to four digits.
TAILS = [
    "card 4532-1234-5678-#",
    "SSN: 123-45-#",
    "mail jane.doe#@example.com",
    "call (555) 123-# or +49 170 123 #",
    "password=hunter# next",
    "pwd: 'pw#' PASS = \"x#\"",
    "api_key=test_mock_key_abcdef# end",
    "Token: eyJhbGciOiJIUzI1#.eyJzdWIiOiIxMjM0#.sig_# end",
    "fetch https://bob:pw#@host.example.com/x",
    "from 10.20.30.40 via 192.168.1.77",
    "mac aa:bb:cc:dd:ee:0f and 00-1B-44-11-3A-B7 and aa:bb-cc:dd:ee:0f",
    "\uE000 keep this, call 555-987-# now \uE001 and \uE000 this too \uE001",
]


def log_lines(spark, sf):
    d = load(spark, sf, "documents")
    tails = F.array(*[F.lit(t) for t in TAILS])
    tail = F.element_at(tails, hashed(F.col("doc_id").cast("string"), len(TAILS)) + 1)
    number = F.format_string("%04d", F.col("doc_id") % 10000)
    return d.select(
        "doc_id", "source", "lang", "n_chars", F.concat_ws(" | ", "text", F.replace(tail, F.lit("#"), number)).alias("text")
    )


SQL_TAIL = f"replace({sql_list(TAILS)}[{sql_hashed('doc_id::VARCHAR', len(TAILS))}+1], '#', printf('%04d', doc_id % 10000))"
SQL_LINES = f"SELECT doc_id, source, lang, n_chars, text||' | '||{SQL_TAIL} AS text FROM documents"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_replace(text: str, pattern: str, mask: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, {literal(mask)}, 'g')"


def sql_rule(text: str, rule: rd.Rule) -> str:
    """The rule in the pattern language of DuckDB: groups as backslash digits, no back-references in patterns."""
    if rule.name == "phone":  # the parts between the matches, each but the first behind a masked match
        parts, found = f"string_split_regex({text}, {literal(rule.pattern)})", f"regexp_extract_all({text}, {literal(rule.pattern)})"
        masked = f"list_transform({found}, lambda m: '***-***-'||right(m, 4))"
        return f"array_to_string(list_transform(list_zip({parts}, list_concat({masked}, [''])), lambda z: z[1]||z[2]), '')"
    if rule.name == "mac_address":
        for sep in "-:":
            pattern = rf"\b[0-9A-Fa-f]{{2}}{sep}(?:[0-9A-Fa-f]{{2}}{sep}){{4}}([0-9A-Fa-f]{{2}})\b"
            text = sql_replace(text, pattern, sep.join(["**"] * 5) + sep + r"\1")
        return text
    return sql_replace(text, rule.pattern, rule.replacement.replace("$", "\\"))


def sql_redact(text: str, rules=rd.RULES) -> str:
    for rule in rules:
        text = sql_rule(text, rule)
    return text


def _one_rule(name: str, rule: rd.Rule):
    @query(name, f"SELECT doc_id, {sql_rule('text', rule)} AS text FROM ({SQL_LINES})")
    def run(spark, sf):
        return log_lines(spark, sf).select("doc_id", rd.apply_rule(F.col("text"), rule).alias("text"))


_one_rule("redact_credit_card", rd.CREDIT_CARD)
_one_rule("redact_ssn", rd.SSN)
_one_rule("redact_email", rd.EMAIL)
_one_rule("redact_phone", rd.PHONE)
_one_rule("redact_password", rd.PASSWORD)
_one_rule("redact_jwt", rd.JWT)
_one_rule("redact_api_key", rd.API_KEY)
_one_rule("redact_ipv4", rd.IPV4)
_one_rule("redact_mac", rd.MAC)


SQL_URLS = "SELECT page_id, replace(url, '://', '://user'||page_id||':pw@') AS url FROM pages"


@query("redact_url_credentials", f"SELECT page_id, {sql_rule('url', rd.URL_CREDENTIALS)} AS url FROM ({SQL_URLS})")
def redact_url_credentials(spark, sf):
    p = load(spark, sf, "pages")
    secret = F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":pw@"))
    return p.select("page_id", rd.apply_rule(F.replace("url", F.lit("://"), secret), rd.URL_CREDENTIALS).alias("url"))


@query("redact_text", f"SELECT doc_id, {sql_redact('text')} AS text FROM ({SQL_LINES})")
def redact_text(spark, sf):
    return log_lines(spark, sf).select("doc_id", rd.redact_text(F.col("text")).alias("text"))


def sql_count(rule: rd.Rule) -> str:
    patterns = [rule.pattern]
    if rule.name == "mac_address":
        patterns = [rf"\b[0-9A-Fa-f]{{2}}{s}(?:[0-9A-Fa-f]{{2}}{s}){{4}}[0-9A-Fa-f]{{2}}\b" for s in "-:"]
    total = "+".join(f"len(regexp_extract_all(text, {literal(p)}))" for p in patterns)
    return f"sum({total})::BIGINT AS {rule.name}"


@query("redaction_stats", f"SELECT lang, {', '.join(sql_count(r) for r in rd.RULES)} FROM ({SQL_LINES}) GROUP BY lang")
def redaction_stats(spark, sf):
    counts = rd.rule_counts(F.col("text"))
    return log_lines(spark, sf).groupBy("lang").agg(*[F.sum(c).alias(n) for n, c in counts.items()])


CUSTOM = r"\b[a-z]{2}\d{3,}\b"
CUSTOM_RULES = rd.add_rule(rd.remove_rule(rd.RULES, "ipv4"), "ticket", CUSTOM)


@query("redact_custom", f"SELECT doc_id, {sql_redact('text', CUSTOM_RULES)} AS text FROM ({SQL_LINES})")
def redact_custom(spark, sf):
    return log_lines(spark, sf).select("doc_id", rd.redact_text(F.col("text"), CUSTOM_RULES).alias("text"))


# A nested record per event: sensitive names at the top, in a struct, in a list and in a map.
def event_records(spark, sf):
    e = load(spark, sf, "events")
    uid = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    mail = F.concat(F.lit("user"), uid, F.lit("@example.com"))
    ip = F.concat(F.lit("10.0.0."), k)
    return e.select(
        "event_id",
        F.concat(F.lit("pw"), k).alias("password"),
        F.struct(mail.alias("contact"), F.concat(F.lit("tok"), k).alias("token"), k.cast("int").alias("k")).alias("account"),
        F.array(F.struct(ip.alias("host"), uid.alias("session_id")), F.struct(F.col("event_type").alias("host"), k.alias("session_id"))).alias("items"),
        F.create_map(F.lit("api_key"), k, F.lit("note"), F.concat(F.lit("mail "), mail)).alias("extra"),
        F.create_map(F.lit("password"), k.cast("int"), F.lit("count"), k.cast("int")).alias("numbers"),
        F.create_map(F.lit("seen"), F.array(ip, mail), F.lit("Token"), F.array(ip)).alias("lists"),
        F.concat(F.lit("seen "), ip).alias("message"),
    )


SQL_RECORDS = f"""SELECT event_id, '[REDACTED]' AS password,
    {sql_redact("'user'||user_id||'@example.com'")} AS contact, '[REDACTED]' AS token, (props->>'$.k')::INT AS k,
    {sql_redact("'10.0.0.'||(props->>'$.k')")}||'/[REDACTED],'||{sql_redact('event_type')}||'/[REDACTED]' AS items,
    'api_key=[REDACTED];note='||{sql_redact("'mail user'||user_id||'@example.com'")} AS extra,
    'null,'||(props->>'$.k') AS numbers, {sql_redact("'10.0.0.'||(props->>'$.k')")}||','||{sql_redact("'user'||user_id||'@example.com'")}||'/null' AS lists,
    {sql_redact("'seen 10.0.0.'||(props->>'$.k')")} AS message FROM events"""


def _flat_records(df):
    return df.select(
        "event_id", "password", F.col("account.contact").alias("contact"), F.col("account.token").alias("token"),
        F.col("account.k").alias("k"),
        F.array_join(F.transform("items", lambda i: F.concat_ws("/", i["host"], i["session_id"])), ",").alias("items"),
        tx.map_as_text(F.col("extra")).alias("extra"), "message",
        F.concat_ws(",", F.coalesce(F.col("numbers")["password"].cast("string"), F.lit("null")), F.col("numbers")["count"].cast("string")).alias("numbers"),
        F.concat_ws("/", F.array_join(F.col("lists")["seen"], ","), F.coalesce(F.array_join(F.col("lists")["Token"], ","), F.lit("null"))).alias("lists"),
    )


@query("redact_record", SQL_RECORDS)
def redact_record(spark, sf):
    return _flat_records(rd.redact_record(event_records(spark, sf)))


@query(
    "log_record",
    f"""SELECT doc_id, CASE WHEN {sql_contains_any('source', tx.SECURITY_LOGGERS)} THEN 'WARNING' ELSE 'INFO' END AS level, source AS logger,
    {sql_redact('text')} AS message, md5('trace'||doc_id) AS trace_id, substr(md5('span'||doc_id), 1, 16) AS span_id,
    'lang='||lang||';n_chars='||n_chars||';token=[REDACTED]' AS context FROM ({SQL_LINES})""",
)
def log_record(spark, sf):
    lines = log_lines(spark, sf)
    key = F.col("doc_id").cast("string")
    context = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("token"), key
    )
    records = lines.select(
        "doc_id",
        F.when(tx.contains_any(F.col("source"), tx.SECURITY_LOGGERS), "WARNING").otherwise("INFO").alias("level"),
        F.col("source").alias("logger"),
        F.col("text").alias("message"),
        F.md5(F.concat(F.lit("trace"), key)).alias("trace_id"),
        F.substring(F.md5(F.concat(F.lit("span"), key)), 1, 16).alias("span_id"),
        context.alias("context"),
    )
    safe = rd.redact_record(records, keep=("level", "logger", "trace_id", "span_id"))
    return safe.withColumn("context", tx.map_as_text(F.col("context")))


@query(
    "audit_record",
    f"""SELECT event_id, 'INFO' AS log_level, 'audit' AS event_type, message, contact, extra FROM ({SQL_RECORDS})""",
)
def audit_record(spark, sf):
    flat = _flat_records(rd.redact_record(event_records(spark, sf)))
    return flat.select(
        "event_id", tx.log_level(F.lit("audit")).alias("log_level"), F.lit("audit").alias("event_type"),
        "message", "contact", "extra",
    )


@query(
    "redact_callable",
    f"SELECT doc_id, regexp_replace(text, '[0-9]', 'N', 'g') AS text FROM ({SQL_LINES})",
)
def redact_callable(spark, sf):
    return log_lines(spark, sf).select("doc_id", rd.redact_with(F.col("text"), lambda t: F.translate(t, "0123456789", "N" * 10)).alias("text"))
