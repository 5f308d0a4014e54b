"""Shared folders for intermediate tables and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Stands in for the setting in local sessions that lack it.
_LOCAL: list[str] = []


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="strandline-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/strandline"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder the session names in ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder. A cluster session
    gets an error, since its executors would not see one another's files there.
    """
    return f"{_base(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new scratch folder and read back, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all this library keeps under the session's scratch folder.

    For when no result that reads from there is needed any more: results of recursion, streams and split
    plans do. It needs a classic session; with Spark Connect, give the folder a lifetime rule.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
