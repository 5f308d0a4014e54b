"""Set operations as one aggregate over both inputs.

Every form follows from how often a row is on the left and on the right. Rows are counted before
the shuffle, so copies of one row are never sent together, and nulls compare as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 100_000


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select("*", one.alias("__l"), none.alias("__r")).unionAll(
        right.select("*", none.alias("__l"), one.alias("__r"))
    )
    return both.groupBy(*left.columns).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionAll(right).distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return _counts(left, right).where("__l > 0 AND __r > 0").drop("__l", "__r")


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return _counts(left, right).where("__l > 0 AND __r = 0").drop("__l", "__r")


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _copies(_counts(left, right), F.least("__l", "__r"))


def subtract_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return _copies(_counts(left, right), F.col("__l") - F.col("__r"))


def _copies(counted: DataFrame, copies: Column) -> DataFrame:
    """Each row as often as ``copies`` says.

    A row's copies are cut into chunks, and chunks are dealt to tasks by row and chunk, so rows with very
    many copies are made by many tasks.
    """
    rows = counted.withColumn("__n", copies).drop("__l", "__r").where("__n > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = rows.withColumn("__start", F.explode(starts)).withColumn("__n", F.least(F.col("__n") - F.col("__start"), F.lit(CHUNK)))
    spread = chunks.repartition(*(F.col(f"`{c}`") for c in chunks.columns if c != "__n"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))
    return spread.withColumn("__copy", copy).drop("__copy", "__n", "__start")
