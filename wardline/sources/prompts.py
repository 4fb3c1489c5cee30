"""Prompt datasets from and to JSON, CSV and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ordering import running_index
from wardline.sources.schemas import PROMPT_SAMPLE

READ_JSON = {"multiLine": "true"}
READ_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of samples; a missing source becomes the file's path."""
    raw = spark.read.schema(PROMPT_SAMPLE).options(**READ_JSON).json(path)
    return raw.withColumn("source", F.coalesce("source", F.col("_metadata.file_path")))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; empty cells are null and metadata is JSON text."""
    columns = "prompt STRING, label INT, source STRING, attack_type STRING, confidence DOUBLE, metadata STRING"
    raw = spark.read.schema(columns).options(**READ_CSV).csv(path)
    return raw.withColumns(
        {
            "source": F.coalesce(F.nullif("source", F.lit("")), F.col("_metadata.file_path")),
            "attack_type": F.nullif("attack_type", F.lit("")),
            "metadata": F.from_json(F.nullif("metadata", F.lit("")), "MAP<STRING,STRING>"),
        }
    )


def load_text(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """One prompt per non-blank line, label 0.

    Line numbers count the lines of a file in the order of its splits: a task numbers the lines it reads, and the lines of
    the splits before are added. A large file stays many tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    metadata = F.lit(None).cast("MAP<STRING,STRING>")
    if line_numbers:
        block = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_n")
        )
        numbered = running_index(block, ["source"], ["_at", "_n"], "_i")
        lines, metadata = numbered.select("source", "line", "_i"), F.create_map(F.lit("line_number"), (F.col("_i") + 1).cast("string"))
    stripped = F.btrim(F.regexp_replace("line", r"[\r\t]", " "))
    return lines.where(stripped != "").select(
        stripped.alias("prompt"), F.lit(0).alias("label"), "source", F.lit(None).cast("string").alias("attack_type"),
        F.lit(None).cast("double").alias("confidence"), metadata.alias("metadata"),
    )


LOADERS = {"json": load_json, "csv": load_csv, "txt": load_text}


def load_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Load by file extension, check, and register as a temporary view."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in LOADERS:
        raise ValueError(f"no loader for .{kind} files")
    df = LOADERS[kind](spark, path)
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    df.createOrReplaceTempView(name)
    return df


def list_datasets(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; empty optional fields are left out."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; empty text for null, metadata as JSON text."""
    flat = df.withColumn("metadata", F.to_json("metadata")).withColumn("confidence", F.col("confidence").cast("string"))
    flat = flat.na.fill("", ["source", "attack_type", "metadata", "confidence"])
    flat.write.mode(mode).options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def save_evaluation(runs: DataFrame, path: str) -> None:
    """Append evaluation rows as JSON, one folder per dataset."""
    runs.write.mode("append").partitionBy("dataset").json(path)
