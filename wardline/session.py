"""Session helpers: settings the operators rely on and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for equal results everywhere; sizes and masters stay the caller's choice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Call sites on every column cost more than the long expressions they would explain.
    spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
    # Long texts and arrays: what a Python worker is handed at once is bounded in bytes, and in rows,
    # as several numbers per token come back for each.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named


def with_local_folder(spark: SparkSession) -> SparkSession:
    """On one machine without spark.checkpoint.dir: a fresh folder that goes when the process ends. For tests and tools."""
    if not spark.conf.get("spark.checkpoint.dir", None) and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def local_session(cores: int = 8, app: str = "wardline") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("WARDLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    return with_local_folder(prepare(session))
