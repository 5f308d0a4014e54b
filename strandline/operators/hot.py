"""Finding groups too large for one task.

A window or join key sends its whole group to one task. Groups that hold more rows than an average
shuffle partition are found here, and the callers split those groups and leave the others alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

# Groups smaller than this never need splitting. Sessions may override it.
HOT_ROWS_CONF = "spark.strandline.hotRows"
HOT_ROWS_DEFAULT = 1_000_000
# Groups larger than this are always split, however large an average partition is. Sessions may override it.
HOT_ROWS_MOST_CONF = "spark.strandline.hotRowsMost"
HOT_ROWS_MOST_DEFAULT = 10_000_000

GROUP = "__group"

# The sketch of frequent keys tracks so many of them; its error is at most this multiple of the rows over that number.
LEAST_TRACKED, MOST_TRACKED = 10_000, 1_000_000
TRACKED_PER_SHARE = 16
SKETCH_ERROR = 4.7
# A group is not hot below one of so many shares of all rows, which bounds the list of hot groups and lets a sketch
# of the largest size tell them.
MOST_SHARES = 100_000
# The sketches of so many tasks are merged first, then those of all such sets: no task merges more up to a million tasks.
MERGED = 1000


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def hot_floor(df: DataFrame, total: int) -> int:
    """The number of rows above which a group of a table of ``total`` rows is hot."""
    most = int(df.sparkSession.conf.get(HOT_ROWS_MOST_CONF, str(HOT_ROWS_MOST_DEFAULT)))
    return max(hot_rows(df), min(most, math.ceil(total / shuffle_partitions(df))), math.ceil(total / MOST_SHARES))


def group_of(keys: list[str]) -> Column:
    """The group key as one struct. Structs compare nulls as equal, so a null key is a group too."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def hot_groups(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The groups of ``df`` that outgrow an average shuffle partition, or None."""
    return counted_groups(df, keys)[1]


def counted_groups(df: DataFrame, keys: list[str]) -> tuple[int, DataFrame | None]:
    """The number of rows, and the groups of ``df`` that outgrow an average shuffle partition, or None.

    A group is also hot above ``hotRowsMost`` rows. No more groups can be hot than there are shuffle partitions,
    or than the rows have such shares, and never more than ``MOST_SHARES``, so the answer may be held by the driver
    and broadcast. Each row has the group as ``__group`` and, as ``pieces``, how many
    such shares it fills; the pieces of all groups together are at most twice the shares.

    One pass over the key columns counts the rows and sketches the most frequent hashes of keys, in bounded memory a
    task and without a shuffle of the keys; the sketch is off by less than half a share. A second pass
    counts the few groups that may be hot.
    """
    group, floor, tracked = group_of(keys), 0, max(LEAST_TRACKED, TRACKED_PER_SHARE * shuffle_partitions(df))
    while True:
        tracked = min(tracked, MOST_TRACKED)
        total, top = _sketched(df.select(F.xxhash64(group).alias("hash")), tracked)
        floor = hot_floor(df, total)
        if total <= floor:
            return total, None
        needed = min(MOST_TRACKED, TRACKED_PER_SHARE * math.ceil(total / floor))
        if tracked >= needed:
            break
        tracked = needed
    likely = [(t["item"],) for t in top if t["count"] > floor - SKETCH_ERROR * total / tracked]
    if not likely:
        return total, None
    likely = F.broadcast(df.sparkSession.createDataFrame(likely, "hash bigint"))
    keyed = df.select(group.alias(GROUP), F.xxhash64(group).alias("hash"))
    sizes = keyed.join(likely, "hash", "left_semi").groupBy(GROUP).agg(F.count(F.lit(1)).alias("rows"))
    largest = with_pieces(sizes.where(F.col("rows") > F.lit(floor)), floor)
    found = largest.collect()
    if not found:
        return total, None
    return total, df.sparkSession.createDataFrame(found, largest.schema)


def with_pieces(sizes: DataFrame, floor: int) -> DataFrame:
    """The ``__group`` of each of ``sizes`` and how many pieces of ``floor`` rows its ``rows`` fill."""
    return sizes.select(GROUP, F.ceil(F.col("rows") / floor).cast("int").alias("pieces"))


def _sketched(hashes: DataFrame, tracked: int) -> tuple[int, list]:
    """The number of rows and the most frequent values of ``hash``, with counts that are not too low.

    Each task sends one sketch. Twice as many values are given as groups can be hot, since counts that are too
    high may put others before them.
    """
    sets = hashes.select("hash", F.floor(F.spark_partition_id() / MERGED).alias("set"))
    sketch = F.expr(f"approx_top_k_accumulate(hash, {tracked})").alias("sketch")
    merged = sets.groupBy("set").agg(F.count(F.lit(1)).alias("rows"), sketch)
    # Grouped, though by one value: Spark fails to merge no sketches at all, as an empty table has.
    whole = merged.groupBy(F.lit("all")).agg(F.sum("rows").alias("rows"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = F.expr(f"approx_top_k_estimate(sketch, {2 * tracked // TRACKED_PER_SHARE})").alias("top")
    found = whole.select("rows", top).first()
    return (found["rows"], found["top"]) if found else (0, [])


def hashable(kind: DataType) -> bool:
    """Whether Spark can hash a column of this type. Maps, and what holds them, it cannot."""
    if isinstance(kind, StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return hashable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def dealt(df: DataFrame, pieces: Column) -> Column:
    """A number below ``pieces`` for each row of ``df``, to deal the rows of a group out evenly.

    It follows from the row and the partition it was read in, not from the order of rows or from
    chance, so a task that is run again deals its rows the same way. The partition tells copies of
    one row apart.
    """
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)]
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), pieces.cast("bigint")).cast("int")
