"""Tables the operators append to and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.ordering import latest_per_key
from wardline.session import shared_folder


# Every append has these types, whatever the caller's.
STORE = {"key": "string", "embedding": "array<float>", "version": "bigint"}


def append_embeddings(rows: DataFrame, path: str | None) -> str:
    """Append (key, embedding, version) rows; without a path, to a new table in the shared folder."""
    path = path or f"{shared_folder(rows.sparkSession)}/embedding_store_{uuid.uuid4().hex}"
    typed = rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in STORE.items()])
    typed.write.mode("append").parquet(path)
    return path


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of every key."""
    schema = ", ".join(f"{name} {kind}" for name, kind in STORE.items())
    return latest_per_key(spark.read.schema(schema).parquet(path), ["key"], ["version"])
