"""Recursive queries as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.sources.scratch import scratch_path

MOST_ROUNDS = 1000


def recurse(start: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``start`` and everything ``step`` reaches from it, as WITH RECURSIVE ... UNION ALL gives.

    Each round's rows are written to shared storage and read back, so a plan never grows past one
    round and a lost executor costs one round at most. The recursion ends with a round that gives
    no rows; all rounds are then read as one table. A recursion that goes round in a circle never comes to
    that, so ``most_rounds`` steps that all gave rows raise an error.
    """
    spark = start.sparkSession
    folder = scratch_path(spark, "recursion")
    last = _written(start, f"{folder}/__round=0")
    for number in range(1, most_rounds + 2):
        if last.isEmpty():
            return spark.read.schema(start.schema).option("basePath", folder).parquet(folder).drop("__round")
        if number > most_rounds:
            break
        last = _written(step(last).select(*start.columns), f"{folder}/__round={number}")
    raise RuntimeError(f"still finding rows after {most_rounds} rounds: is there a cycle?")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
