"""Parquet in and out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory that holds ``<name>.parquet`` per table."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Write one directory per value of ``by``, in files of the size adaptive execution aims for.

    Rebalancing sends the rows of a value to one task where they fit and splits a value that holds
    much of the table over many tasks, each of which writes a file of its own.
    """
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)
