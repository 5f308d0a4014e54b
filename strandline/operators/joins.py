"""Joins that Spark has no call for, and joins on keys with hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.operators.hot import GROUP, dealt, group_of, hot_floor, hot_groups, with_pieces
from strandline.operators.scan import FIND, Wanted, find_split, ntz_micros, scan
from strandline.sources import written


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None | str = FIND
) -> DataFrame:
    """Inner, left, semi or anti join whose ``left`` side may have hot keys; they are looked for unless given.

    Left rows with a hot key are dealt over as many salts as average partitions the key fills, and
    right rows with such a key are copied to each of its salts. Other rows keep salt 0 and are not
    copied.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting the left side cannot serve a {how} join")
    if hot is FIND:
        hot = hot_groups(left, on)
    if hot is None:
        return left.join(right, on, how)
    keys = F.broadcast(hot.select(F.col(GROUP).alias("__key"), "pieces"))
    pieces = F.col("pieces")
    salt = F.coalesce(dealt(left, pieces), F.lit(0))
    salts = F.when(pieces.isNotNull(), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.lit(0)))
    left = (
        left.withColumn("__key", group_of(on))
        .join(keys, "__key", "left")
        .withColumn("__salt", salt)
        .drop("pieces", "__key")
    )
    right = (
        right.withColumn("__key", group_of(on))
        .join(keys, "__key", "left")
        .withColumn("__salt", F.explode(salts))
        .drop("pieces", "__key")
    )
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    seconds: int,
) -> DataFrame:
    """Pairs with equal keys whose right time is at or up to ``seconds`` after the left time.

    Times are cut into buckets ``seconds`` long. A left row can only meet right rows of its own
    bucket or the next, so it is sent to both and right rows go to one. The bucket is part of the
    join key, so a hot key is spread over its time range. A bucket that is hot by itself has its left rows
    dealt over several tasks.
    """
    span = seconds * 1_000_000
    left = left.withColumn("__from", ntz_micros(F.col(left_time)))
    right = right.withColumn("__at", ntz_micros(F.col(right_time)))
    bucket = F.floor(F.col("__from") / span)
    left = left.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    right = right.withColumn("__bucket", F.floor(F.col("__at") / span))
    pairs = salted_join(left, right, [*keys, "__bucket"])
    after = F.col("__at") - F.col("__from")
    return pairs.where((after >= 0) & (after <= span)).drop("__bucket", "__from", "__at")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_order: list[str],
    right_order: list[str],
    values: list[str],
) -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key, at or before its time.

    The first column of each order is the time and the second a unique id of the row. Without an
    earlier right row the values are null. Both sides are stacked and the latest right row is
    carried forward in one pass, so no pairs are formed.
    """
    latest = F.struct(*(F.col(v) for v in values))
    kind = right.select(latest.alias("s")).schema["s"].dataType
    row = F.struct(*left.columns)
    row_kind = left.select(row.alias("s")).schema["s"].dataType
    stacked = right.select(
        *keys,
        F.col(right_order[0]).alias("__time"),
        F.lit(0).alias("__side"),
        F.col(right_order[1]).alias("__id"),
        latest.alias("__value"),
        F.lit(None).cast(row_kind).alias("__row"),
    ).unionAll(
        left.select(
            *keys,
            F.col(left_order[0]).alias("__time"),
            F.lit(1).alias("__side"),
            F.col(left_order[1]).alias("__id"),
            F.lit(None).cast(kind).alias("__value"),
            row.alias("__row"),
        )
    )
    wanted = Wanted(lasts={"__latest": F.col("__value")})
    carried = scan(stacked, keys, ["__time", "__side", "__id"], wanted)
    rows = carried.where(F.col("__side") == 1)
    return rows.select(
        *(F.col("__row")[c].alias(c) for c in left.columns),
        *(F.col("__latest")[v].alias(v) for v in values),
    )


def interval_totals(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    left_time: str,
    right_time: str,
    seconds: int,
    sums: dict[str, Column],
) -> DataFrame:
    """For each left row, sums over the right rows of its key in the last ``seconds``, ends included.

    Equals a range join followed by a sum per left row, without the pairs: running totals are read
    off at both ends of the interval and subtracted. The sums should be over whole numbers or
    decimals, since subtracting running floating point totals loses digits. Gives the keys, the
    left id and the sums.

    Both sides are first added up to one row per key and time, so that a time that many rows share is one row of
    the scan and asks once. The answers are joined back with the rows of such a time dealt out.
    """
    asked = left.select(*keys, left_id, ntz_micros(F.col(left_time)).alias("__at"))
    kinds = {n: right.select(c.alias(n)).schema[n].dataType for n, c in sums.items()}
    given = right.select(*keys, ntz_micros(F.col(right_time)).alias("__at"), *(c.alias(n) for n, c in sums.items()), F.lit(0).alias("__asks"))
    asks = asked.select(*keys, "__at", *(F.lit(None).cast(k).alias(n) for n, k in kinds.items()), F.lit(1).alias("__asks"))
    return _read_off(asked, given.unionAll(asks), keys, left_id, seconds, kinds)


def own_interval_totals(df: DataFrame, keys: list[str], id: str, time: str, seconds: int, sums: dict[str, Column]) -> DataFrame:
    """``interval_totals`` of a table with itself."""
    kinds = {n: df.select(c.alias(n)).schema[n].dataType for n, c in sums.items()}
    asked = df.select(*keys, id, ntz_micros(F.col(time)).alias("__at"))
    both = df.select(*keys, ntz_micros(F.col(time)).alias("__at"), *(c.alias(n) for n, c in sums.items()), F.lit(1).alias("__asks"))
    return _read_off(asked, both, keys, id, seconds, kinds)


def _read_off(asked: DataFrame, both: DataFrame, keys: list[str], left_id: str, seconds: int, kinds: dict) -> DataFrame:
    """Sums for each row of ``asked``, out of values and asks at the times of both sides.

    One row per key and time is written once; hot keys, cut points, crowded times and both ends of the intervals
    come from that table. The upper end of an interval is the running total at its own time; the lower end is a row
    of its own, before those of its time.
    """
    counted = F.sum("__asks").alias("__asks")
    adds = (F.coalesce(F.sum(n).cast(k), F.lit(0).cast(k)).alias(n) for n, k in kinds.items())
    times = written(both.groupBy(*keys, "__at").agg(*adds, counted), "interval-times")
    split = find_split(times, keys, ["__at"])
    asking = F.col("__asks") > 0
    own = times.select(*keys, "__at", F.lit(1).alias("__side"), F.col("__at").alias("__for"), asking.alias("__asking"), *kinds)
    lower = (F.col("__at") - seconds * 1_000_000).alias("__at")
    ends = times.where(asking).select(
        *keys, lower, F.lit(0).alias("__side"), F.col("__at").alias("__for"), F.lit(True).alias("__asking"), *(F.lit(0).cast(k).alias(n) for n, k in kinds.items())
    )
    wanted = Wanted(sums={f"__{n}": F.col(n) for n in kinds})
    totals = scan(own.unionAll(ends), keys, ["__at", "__side"], wanted, split)
    sign = F.when(F.col("__side") == 1, F.lit(1)).otherwise(F.lit(-1))
    answers = (
        totals.where("__asking")
        .groupBy(F.struct(*keys, F.col("__for").alias("__at")).alias(GROUP))
        .agg(*(F.sum(sign * F.col(f"__{n}")).alias(n) for n in kinds))
    )
    return salted_join(
        asked.withColumn(GROUP, F.struct(*keys, "__at")), answers, [GROUP], hot=_crowded(times, keys)
    ).select(*keys, left_id, *kinds)


def _crowded(times: DataFrame, keys: list[str]) -> DataFrame | None:
    """The times at which more rows ask than one task should join, as ``hot_groups`` of those rows would give them."""
    asks = times.agg(F.sum("__asks").alias("all"), F.max("__asks").alias("most")).first()
    floor = hot_floor(times, asks["all"] or 0)
    if (asks["most"] or 0) <= floor:
        return None
    sizes = times.where(F.col("__asks") > floor).select(F.struct(*keys, "__at").alias(GROUP), F.col("__asks").alias("rows"))
    # The join is on the group as its one column.
    return with_pieces(sizes.select(F.struct(GROUP).alias(GROUP), "rows"), floor)


def best_per_key(
    df: DataFrame, keys: list[str], by: list[Column], columns: list[str]
) -> DataFrame:
    """The row of each key that is greatest in ``by``, as an aggregate.

    Each task keeps one row per key before the shuffle, so a hot key costs no more than any other.
    """
    best = F.max_by(F.struct(*columns), F.struct(*by)).alias("__best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *(F.col("__best")[c].alias(c) for c in columns))
