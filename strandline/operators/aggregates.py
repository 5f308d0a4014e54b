"""Aggregates whose plain form holds a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.operators.hot import GROUP, dealt, group_of, hot_groups
from strandline.operators.scan import Wanted, find_split, scan


def exact_percentile(
    df: DataFrame, keys: list[str], column: str, shares: dict[str, float]
) -> DataFrame:
    """Exact interpolated percentiles of a column per group, as output name to share of the rows.

    Equal values are counted before the shuffle and the counts are added up along the values, so no
    task holds the values of a whole group as ``percentile`` does. Nulls are left out.
    """
    rows = df.where(F.col(column).isNotNull())
    counted = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    wanted = Wanted(sums={"__upto": F.col("__n")}, totals={"__of": F.col("__n")})
    placed = scan(counted, keys, [column], wanted, find_split(rows, keys, [column]))
    value = F.col(column).cast("double")

    def at(place):
        here = (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__n"))
        return F.max(F.when(here, value))

    aggs = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("__of") - 1)
        aggs.append(at(F.floor(place)).alias(f"__low_{name}"))
        aggs.append(at(F.ceil(place)).alias(f"__high_{name}"))
    found = placed.groupBy(*keys, "__of").agg(*aggs)
    out = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("__of") - 1)
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *out)


def blocks(df: DataFrame, keys: list[str], name: str = "block") -> DataFrame:
    """Deal the rows of hot keys to blocks, to bound what a grouped UDF is handed.

    A group of a grouped UDF is held in a Python worker whole. Grouped by key and block it is no larger than
    a hot group may be, and gives partial results; adding those up is left to a built-in aggregate.
    Keys that are not hot keep one block, so many small keys stay as many groups.
    """
    hot = hot_groups(df, keys)
    if hot is None:
        return df.withColumn(name, F.lit(0))
    marked = df.withColumn(GROUP, group_of(keys)).join(F.broadcast(hot), GROUP, "left")
    block = F.coalesce(dealt(df, F.col("pieces")), F.lit(0))
    return marked.withColumn(name, block).drop(GROUP, "pieces")
