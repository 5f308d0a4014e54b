"""Windows over event time in batch queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strandline.operators.scan import Wanted, find_split, ntz_micros, scan
from strandline.sources.scratch import written


UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6, "week": 604_800 * 10**6}


def micros(interval: str) -> int:
    """The length of an interval such as ``1 day 6 hours`` in microseconds."""
    words = interval.lower().removeprefix("interval ").split()
    pairs = list(zip(words[::2], (w.removesuffix("s") for w in words[1::2])))
    if not pairs or len(words) % 2 or any(u not in UNITS or not n.isdigit() for n, u in pairs):
        raise ValueError(f"{interval!r} is not a whole number of weeks, days, hours or smaller units")
    return sum(int(n) * UNITS[u] for n, u in pairs)


def tumbling(
    df: DataFrame, time: str, size: str, keys: list[str], aggs: list[Column]
) -> DataFrame:
    """Aggregates per key and window of ``size``, with the window as ``start`` and ``end``."""
    grouped = df.groupBy(F.window(time, size).alias("__w"), *keys).agg(*aggs)
    return grouped.select(
        F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), "*"
    ).drop("__w")


def sliding_sums(
    df: DataFrame, time: str, size: str, slide: str, keys: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Sums per key and sliding window.

    Rows are first added up per pane, the longest span that divides both ``size`` and ``slide``, and only those
    sums are copied to the windows they are in. Both must be of fixed length, so not months or years.
    """
    pane = math.gcd(micros(size), micros(slide))
    panes = tumbling(df, time, f"{pane} microseconds", keys, [F.sum(c).alias(n) for n, c in sums.items()])
    grouped = panes.groupBy(F.window("start", size, slide).alias("__w"), *keys).agg(
        *(F.sum(n).alias(n) for n in sums)
    )
    return grouped.select(
        F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *sums
    )


def session_starts(
    df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: int, name: str
) -> DataFrame:
    """Add the start of the session each row is in. A session ends with a gap over ``gap_seconds``.

    Aggregating by key and session start then needs no ordering, and a session of any size is added
    up before the shuffle. ``session_window`` would bring all rows of a key to one task.
    """
    order = [time, tie]
    split = find_split(df, keys, order)
    wanted = Wanted(lags={"__previous": F.col(time)})
    with_previous = scan(df, keys, order, wanted, split, keep=True)
    if split is not None:  # the next scan reads its rows twice
        with_previous = written(with_previous, "sessions")
    since = ntz_micros(F.col(time)) - ntz_micros(F.col("__previous"))
    opens = F.col("__previous").isNull() | (since > gap_seconds * 1_000_000)
    marked = with_previous.withColumn("__opens", F.when(opens, F.col(time)))
    placed = scan(marked, keys, order, Wanted(lasts={name: F.col("__opens")}), split)
    return placed.drop("__previous", "__opens")
