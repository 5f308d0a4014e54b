"""Streaming operators. Times are timestamps without zone; watermarks need one with a zone.

A wall-clock time is read as UTC while the stream runs and given back without zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandline.operators.scan import ntz_micros


def zoned(c: str | Column) -> Column:
    """A timestamp without zone as the instant it names in UTC, whatever the session time zone."""
    return F.timestamp_micros(ntz_micros(F.col(c) if isinstance(c, str) else c))


def unzoned(c: str | Column) -> Column:
    """An instant as the time it has in UTC, without zone."""
    since = F.unix_micros(c).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=since.cast("decimal(18,6)"))


def event_time(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``stream`` with a watermark ``delay`` behind its latest time."""
    return stream.withColumn(time, zoned(time)).withWatermark(time, delay)


def windowed(
    stream: DataFrame, window: Column, keys: list[str], aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates per window and key. Rows are added up per task before the shuffle."""
    grouped = stream.groupBy(window.alias("__w"), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return grouped.select(
        *keys,
        unzoned(F.col("__w")["start"]).alias("start"),
        unzoned(F.col("__w")["end"]).alias("end"),
        *aggs,
    )


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int
) -> DataFrame:
    """Pairs with equal keys whose right time is at or up to ``seconds`` after the left time.

    Both sides must have a watermark, so state is dropped once the interval has passed. The time
    bucket in the join key spreads the state of a hot key, as in the batch range join.
    """
    bucket = F.floor(F.unix_seconds(left_time) / seconds)
    left = left.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    right = right.withColumn("__bucket", F.floor(F.unix_seconds(right_time) / seconds))
    left, right = left.alias("l"), right.alias("r")
    same = F.col("l.__bucket") == F.col("r.__bucket")
    for key in keys:
        same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    start, at = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    near = (at >= start) & (at <= start + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(right, same & near)


def partial_sums(stream: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums per key of each Arrow batch of a stream of files, without state.

    Written to files, they add up to the totals since the start, whatever the number of keys; each run of the stream
    reads new files only. Sums are over whole numbers and null where all values are. A batch whose sums might not fit
    a bigint is an error: one of 10,000 rows with a value of 2**49 or more.
    """
    narrow, names = stream.select(*keys, *(c.cast("long").alias(n) for n, c in sums.items())), list(sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                fits_bigint(batch.column(name))
            added = pa.Table.from_batches([batch]).group_by(keys).aggregate([(n, "sum") for n in names])
            yield from added.select([*keys, *(f"{n}_sum" for n in names)]).rename_columns([*keys, *names]).to_batches()

    return narrow.mapInArrow(add_up, narrow.schema)


def fits_bigint(values: pa.Array) -> None:
    """Raise an error where sums over whole numbers might wrap."""
    ends = pc.min_max(values).as_py()
    if max(abs(v or 0) for v in ends.values()) * len(values) >= 2**63:
        raise OverflowError("a sum might not fit a bigint")


Rule = Callable[[tuple | None, pd.DataFrame], tuple[list[tuple], tuple | None]]


def keyed_state(
    stream: DataFrame, keys: list[str], time: str, order: list[str], rule: Rule, close: Callable[[tuple], list[tuple]], state: str, output: str, silence_ms: int
) -> DataFrame:
    """A rule of the caller's that reads each key's rows in order and keeps state between batches.

    ``rule`` gets the key's state (None at first) and its new rows of a batch, sorted by ``order``, and gives rows to put out and
    the state to keep (None for none). A key that has been silent for ``silence_ms`` of event time, as the
    watermark tells, is handed to ``close`` for its last rows and forgotten. ``time`` is an instant with a watermark; rows later than
    that are dropped. ``state`` and ``output`` are schemas; the rows put out follow the keys.

    A key's rows of one batch are sorted in one worker, so bound what a batch takes in.
    """
    instant = "__ms"
    # The earliest and the latest row of a state are not the rule's business, so the time to forget it is kept beside it.
    held = f"{state}, {instant} long"
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    timed = stream.withColumn(instant, F.unix_millis(time))

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            found = close(tuple(group.get)[:-1])
            group.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(order)
            before = tuple(group.get) if group.exists else None
            found, kept = rule(before[:-1] if before else None, rows)
            last = max(int(rows[instant].max()), before[-1] if before else 0)
            if kept is None:
                if group.exists:
                    group.remove()
            else:
                group.update((*kept, last))
                group.setTimeoutTimestamp(max(last + silence_ms, group.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame([(*key, *row) for row in found], columns=names)

    schema = f"{kinds}, {output}"
    names = [*keys, *StructType.fromDDL(output).names]
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


STREAK = "first_us long, last_us long, n long, cents long"


def ended_streaks(state: tuple | None, us: np.ndarray, broken: np.ndarray, cents: np.ndarray, gap: int) -> tuple[list[tuple], tuple | None]:
    """The streaks that rows in order bring to an end, and the one still open; ``state`` is the one open before.

    The open one stands before the rows as one more row. A streak begins at a row that is not broken and follows a broken
    one or a gap; broken rows up to the next beginning add nothing to it.
    """
    fits_bigint(pa.array(cents))
    first, n = us, np.ones(len(us), np.int64)
    if state is not None:
        fits_bigint(pa.array([state[3], int(np.abs(cents).sum())]))
        first, us, n, cents = (np.concatenate([[s], a]) for s, a in zip(state, (first, us, n, cents)))
        broken = np.concatenate([[False], broken])
    begins = ~broken
    begins[1:] &= broken[:-1] | (np.diff(us) > gap)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [], None
    rows = np.add.reduceat((~broken).astype(np.int64), starts)
    sums = (np.add.reduceat(np.where(broken, 0, a), starts) for a in (n, cents))
    found = list(zip(*(a.tolist() for a in (first[starts], us[starts + rows - 1], *sums))))
    return (found, None) if broken[-1] else (found[:-1], found[-1])


def streaks(stream: DataFrame, key: str, time: str, id: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's rows that are not ``broken``, in time order, with no gap over ``gap_seconds`` between neighbours.

    A streak is put out when a broken row, a gap or the watermark ends it: ``first_us`` and ``last_us`` (microseconds
    since 1970), ``n`` and the sum of ``cents``. A null ``broken`` is false, a null in ``cents`` adds nothing; sums that might not fit a
    bigint are an error.
    """
    gap = gap_seconds * 1_000_000

    def rule(state: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        us, broken, cents = (rows[c].to_numpy() for c in ("__us", "broken", "cents"))
        return ended_streaks(state, us, broken, cents, gap)

    whole = {"broken": F.coalesce("broken", F.lit(False)), "cents": F.coalesce("cents", F.lit(0).cast("bigint"))}
    rows = stream.withColumns({"__us": F.unix_micros(time), **whole})
    return keyed_state(rows, [key], time, ["__us", id], rule, lambda state: [state], STREAK, STREAK, gap_seconds * 1000)
