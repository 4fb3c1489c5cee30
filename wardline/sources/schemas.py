"""Record schemas: prompt samples, events, and the security, trace and metric log templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_SAMPLE = (
    "prompt STRING, label INT, source STRING, attack_type STRING, confidence DOUBLE, metadata MAP<STRING,STRING>"
)

SECURITY_LOG = (
    "`@timestamp` TIMESTAMP, event_id STRING, event_type STRING, category STRING, threat_level STRING, message STRING, "
    "source_ip STRING, user_id STRING, session_id STRING, request_id STRING, blocked BOOLEAN, confidence DOUBLE, "
    "attack_vectors ARRAY<STRUCT<technique:STRING,tactic:STRING,description:STRING,severity:STRING>>, "
    "indicators ARRAY<STRUCT<type:STRING,value:STRING,confidence:DOUBLE,description:STRING>>, "
    "tags ARRAY<STRING>, raw_data MAP<STRING,STRING>"
)
TRACE_LOG = (
    "`@timestamp` TIMESTAMP, trace_id STRING, span_id STRING, parent_span_id STRING, operation_name STRING, "
    "duration_ms DOUBLE, status STRING, service STRING, attributes MAP<STRING,STRING>"
)
METRIC_LOG = "`@timestamp` TIMESTAMP, metric_name STRING, metric_value DOUBLE, metric_type STRING, tags MAP<STRING,STRING>"
TEMPLATES = {"security": SECURITY_LOG, "trace": TRACE_LOG, "metric": METRIC_LOG}

CORRUPT = "_corrupt"


def typed_logs(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """JSON text as typed columns; text that does not fit the schema stays in `_corrupt`."""
    parsed = F.from_json(
        json_col, f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return df.withColumn("_r", parsed).select("*", "_r.*").drop("_r")


def variant_logs(df: DataFrame, json_col: str, fields: dict[str, tuple[str, str]], payload: str = "raw_data") -> DataFrame:
    """JSON text with fields nobody declared: the whole value as a VARIANT, named (path, type) fields taken out of it.

    A field that is missing, or has a value that its type cannot hold, is null; the same name may hold numbers in one row and
    objects in the next. Text that is not JSON has a null payload and stays in `_corrupt`; null text has neither.
    """
    parsed = df.withColumn(payload, F.try_parse_json(json_col))
    typed = {name: F.try_variant_get(payload, path, kind) for name, (path, kind) in fields.items()}
    bad = F.when(F.col(json_col).isNotNull() & F.col(payload).isNull(), F.col(json_col))
    return parsed.withColumns({**typed, CORRUPT: bad})


def variant_schemas(df: DataFrame, keys: list[str], payload: str = "raw_data") -> DataFrame:
    """Per key the schema that all its payloads fit, fields of mixed types as VARIANT; a partial aggregate of schemas."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(payload).alias("schema"), F.count(payload).alias("n"))


def daily_index(prefix: str, ts: Column) -> Column:
    """Name of the day's index: prefix-YYYY.MM.DD."""
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyy.MM.dd"))


def bulk_write_report(df: DataFrame, index: Column, valid: Column) -> DataFrame:
    """Rows accepted and rejected per target index, as a bulk write would report them."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(index.alias("_index")).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"))
