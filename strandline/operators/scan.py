"""Running values within groups, where a group may be larger than a task can hold.

``scan`` gives what ``SUM() OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)`` and
its relatives give. Without hot groups that window is the plan. With them, the rows of each hot
group are cut along the order into segments, the window runs inside each segment, and what earlier
segments add up to is joined back from a table of one row per segment. Either way the rows are
shuffled once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.operators.hot import GROUP, counted_groups, group_of, shuffle_partitions

SEGMENT = "__segment"
HOT = "__hot"
QUANTILES = 64
# Cut points are taken from about this many rows.
SAMPLE_ROWS = 500_000

# Cut points of a text column are taken from about this many values, cut to this length.
TEXT_SAMPLE, TEXT_LENGTH = 4_000, 100

INTEGERS = ("tinyint", "smallint", "int", "bigint")
FLOATS = ("float", "double")
FIND = "find"


@dataclass(frozen=True)
class Wanted:
    """What a scan adds to each row, as output name to input column.

    sums: running sum up to the row. totals: sum over the whole group. lasts: latest value that is
    not null, up to the row. firsts: value of the group's first row. lags, leads: value of the row
    before and after.
    """

    sums: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    lasts: dict[str, Column] = field(default_factory=dict)
    firsts: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, Column] = field(default_factory=dict)
    leads: dict[str, Column] = field(default_factory=dict)

    def names(self) -> list[str]:
        kinds = (self.sums, self.totals, self.lasts, self.firsts, self.lags, self.leads)
        return [name for kind in kinds for name in kind]


@dataclass(frozen=True)
class Cuts:
    """Cut points of the first order column and the range of the second.

    ``steps`` is the number of further cuts between two points. ``tie_steps`` is that among the rows
    equal to each point, then among those that are not a number and those that are null, in
    proportion to how many they are.
    """

    points: list
    tie_low: object
    tie_high: object
    steps: int
    tie_steps: list[int]


@dataclass(frozen=True)
class Split:
    """The hot groups of a table and where they are cut along the order."""

    hot: DataFrame | None
    cuts: Cuts | None


def find_split(df: DataFrame, keys: list[str], order: list[str]) -> Split | None:
    """How to split ``df`` for a scan with these keys and this order; None where no group is hot.

    Without keys the table is one group and is always split. An order that cannot be cut is refused whatever
    the size of ``df``.

    Reads the key and order columns of ``df`` only, and takes the cut points from a sample where it
    is large: they set how even the pieces are, not what comes out. A split may be used for any table
    with the same keys and order columns, so it can be found in a plain table and used for what is
    derived from it.
    """
    for name in order[:1]:
        _number(df, name)
    if keys:
        total, hot = counted_groups(df, keys)
        if hot is None:
            return None
    else:
        total, hot = df.count(), None
    sample = df if total <= SAMPLE_ROWS else df.sample(SAMPLE_ROWS / total, seed=1)
    if not keys:
        return Split(None, _cut_points(sample, order))
    hot = F.broadcast(hot.select(GROUP, F.lit(True).alias(HOT)))
    sample = sample.withColumn(GROUP, group_of(keys)).join(hot, GROUP)
    return Split(hot, _cut_points(sample, order))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    wanted: Wanted,
    split: Split | None | str = FIND,
    keep: bool = False,
) -> DataFrame:
    """Add the wanted columns to every row of ``df``.

    ``order`` must order the rows of a group fully, and its first column must be a number, date,
    timestamp, boolean or text. With ``keep`` the segments of a split table stay in it as columns, and a further scan
    in the same order works on them without another shuffle; ``drop_segments`` takes them out.
    """
    if split is FIND:
        split = find_split(df, keys, order)
    if split is None:
        return df.select("*", *_window_columns(wanted, Window.partitionBy(*keys), order))
    return _segmented(df, keys, order, wanted, split, keep)


def drop_segments(df: DataFrame) -> DataFrame:
    return df.drop(GROUP, SEGMENT, HOT)


def _window_columns(wanted: Wanted, groups, order: list[str]) -> list[Column]:
    ordered = groups.orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [
        *(F.sum(c).over(so_far).alias(n) for n, c in wanted.sums.items()),
        *(F.sum(c).over(groups).alias(n) for n, c in wanted.totals.items()),
        *(F.last(c, ignorenulls=True).over(so_far).alias(n) for n, c in wanted.lasts.items()),
        *(F.first(c).over(so_far).alias(n) for n, c in wanted.firsts.items()),
        *(F.lag(c).over(ordered).alias(n) for n, c in wanted.lags.items()),
        *(F.lead(c).over(ordered).alias(n) for n, c in wanted.leads.items()),
    ]


def _segmented(
    df: DataFrame, keys: list[str], order: list[str], wanted: Wanted, split: Split, keep: bool
) -> DataFrame:
    if SEGMENT in df.columns:
        rows = df
        hot_only = df.where(F.col(HOT))
    else:
        grouped = df.withColumn(GROUP, group_of(keys))
        if split.hot is None:
            marked = hot_only = grouped.withColumn(HOT, F.lit(True))
        else:
            marked = grouped.join(split.hot, GROUP, "left")
            hot_only = grouped.join(split.hot, GROUP)
        rows = _with_segment(marked, order, split.cuts)
        hot_only = _with_segment(hot_only, order, split.cuts)
    own = [c for c in rows.columns if keep or c not in (GROUP, SEGMENT, HOT)]

    segments = Window.partitionBy(GROUP, SEGMENT)
    local = rows.select(
        "*",
        *_window_columns(wanted, segments, order),
        F.row_number().over(segments.orderBy(*order)).alias("__segment_nth"),
        F.count(F.lit(1)).over(segments).alias("__segment_of"),
    )
    joined = local.join(_carried(hot_only, order, wanted), [GROUP, SEGMENT], "left")
    types = local.schema
    return joined.select(
        *(F.col(f"`{c}`") for c in own),
        *(c.cast(types[n].dataType).alias(n) for n, c in _combined(wanted).items()),
    )


def _combined(wanted: Wanted) -> dict[str, Column]:
    """Local value of each row put together with what the other segments of its group carry."""
    carry = {name: F.col(f"__carry_{name}") for name in wanted.names()}
    hot = F.col("__carried").isNotNull()
    at_start = hot & (F.col("__segment_nth") == 1)
    at_end = hot & (F.col("__segment_nth") == F.col("__segment_of"))
    out = {}
    for name in wanted.sums:
        out[name] = F.coalesce(F.col(name) + carry[name], F.col(name), carry[name])
    for name in wanted.totals:
        out[name] = F.when(hot, carry[name]).otherwise(F.col(name))
    for name in wanted.lasts:
        out[name] = F.coalesce(F.col(name), carry[name])
    for name in wanted.firsts:
        out[name] = F.when(hot, carry[name]["v"]).otherwise(F.col(name))
    for name in wanted.lags:
        out[name] = F.when(at_start, carry[name]["v"]).otherwise(F.col(name))
    for name in wanted.leads:
        out[name] = F.when(at_end, carry[name]["v"]).otherwise(F.col(name))
    return out


def _carried(rows: DataFrame, order: list[str], wanted: Wanted) -> DataFrame:
    """One row per segment of the hot groups, with what the other segments hand to it.

    The window below runs over segments, of which a group has a bounded number.
    """
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    # A null first in the order would be skipped by min_by and max_by, so wrap it.
    position = F.struct(position)
    aggs = []
    for name, c in {**wanted.sums, **wanted.totals}.items():
        aggs.append(F.sum(c).alias(name))
    for name, c in wanted.lasts.items():
        aggs.append(F.max_by(c, F.when(c.isNotNull(), position)).alias(name))
    for name, c in {**wanted.firsts, **wanted.leads}.items():
        aggs.append(F.min_by(F.struct(c.alias("v")), position).alias(name))
    for name, c in wanted.lags.items():
        aggs.append(F.max_by(F.struct(c.alias("v")), position).alias(name))
    aggs.append(F.count(F.lit(1)).alias("__carried"))
    per_segment = rows.groupBy(GROUP, SEGMENT).agg(*aggs)

    group = Window.partitionBy(GROUP)
    ordered = group.orderBy(SEGMENT)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    from_start = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = [
        *(F.sum(n).over(before).alias(f"__carry_{n}") for n in wanted.sums),
        *(F.sum(n).over(group).alias(f"__carry_{n}") for n in wanted.totals),
        *(F.last(n, ignorenulls=True).over(before).alias(f"__carry_{n}") for n in wanted.lasts),
        *(F.first(n).over(from_start).alias(f"__carry_{n}") for n in wanted.firsts),
        *(F.lag(n).over(ordered).alias(f"__carry_{n}") for n in wanted.lags),
        *(F.lead(n).over(ordered).alias(f"__carry_{n}") for n in wanted.leads),
    ]
    return per_segment.select(GROUP, SEGMENT, "__carried", *carry)


def _cut_points(rows: DataFrame, order: list[str]) -> Cuts:
    pieces = 4 * shuffle_partitions(rows)
    quantiles = min(QUANTILES, pieces)
    shares = [i / quantiles for i in range(1, quantiles)]
    x, nan, tie = _number(rows, order[0]), _not_a_number(rows, order[0]), _tie(rows, order)
    found = rows.select(x.alias("x"), nan.alias("nan"), tie.alias("tie")).agg(
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.percentile_approx("x", shares, 2_000).alias("points"),
        F.min("tie").alias("tie_low"),
        F.max("tie").alias("tie_high"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("nan").alias("nans"),
        F.count_if(F.col("x").isNull() & ~F.col("nan")).alias("nulls"),
    ).first()
    if dict(rows.dtypes)[order[0]] == "string":
        shares = _text_quantiles(rows, order[0], quantiles)
        points = sorted(set(shares), key=str.encode) or [""]
        found = found.asDict() | {"points": shares, "nulls": found["nulls"]}
    else:
        points = sorted({found["low"], *(found["points"] or ()), found["high"]} - {None}) or [0]
    steps = math.ceil(pieces / quantiles)
    # A value that is several quantiles at once holds as many shares of the rows.
    tie_steps = [steps * max(1, (found["points"] or []).count(p)) for p in points]
    for n in (found["nans"], found["nulls"]):
        tie_steps.append(max(1, math.ceil(pieces * n / max(1, found["n"]))))
    return Cuts(points, found["tie_low"], found["tie_high"], steps, tie_steps)


def _text_quantiles(rows: DataFrame, name: str, quantiles: int) -> list[str]:
    """Texts that cut a column into about equal parts, from a sample. A text may come several times."""
    text = F.substring(F.col(f"`{name}`"), 1, TEXT_LENGTH).alias("x")
    drawn = rows.where(F.col(f"`{name}`").isNotNull()).select(text).orderBy(F.rand(1)).limit(TEXT_SAMPLE).collect()
    values = sorted((r["x"] for r in drawn), key=str.encode)
    return [values[len(values) * n // quantiles] for n in range(1, quantiles)] if values else []


def _with_segment(df: DataFrame, order: list[str], cuts: Cuts) -> DataFrame:
    """Number the segments of hot rows so that the number never falls along the order.

    Rows equal to a cut point form a cell of their own, cut further along the second order column,
    so a value that many rows share is split as well; so do nulls, which come first, and rows that
    are not a number, which come last. Rows between two cut points are cut further by even steps.
    The columns are added one by one to keep each expression small.
    """
    count = len(cuts.points)
    points = F.array(*(F.lit(p) for p in cuts.points))
    tie_steps = F.array(*(F.lit(n) for n in cuts.tie_steps))
    x, cell, low, nan = (F.col(c) for c in ("__x", "__cell", "__low", "__nan"))
    tied = nan | x.isNull() | (x == low)
    tie_step = _step(
        F.col("__tie").cast("double"),
        F.lit(cuts.tie_low).cast("double"),
        F.lit(cuts.tie_high).cast("double"),
        F.element_at(
            tie_steps,
            F.when(nan, count + 1).when(x.isNull(), count + 2).otherwise(F.greatest(cell, F.lit(1))),
        ),
    )
    number = _text_number if isinstance(cuts.points[0], str) else lambda c: c.cast("double")
    between = _step(number(x), number(low), number(F.col("__high")), F.lit(cuts.steps))
    step = F.when(tied, tie_step).otherwise(between)
    place = (
        F.when(nan, 2 * (count + 1))
        .when(x.isNull(), 0)
        .otherwise(2 * cell + F.when(x == low, 0).otherwise(1))
    )
    number = place.cast("bigint") * max(cuts.tie_steps) + step
    return (
        df.withColumns(
            {
                "__x": F.col(f"`{order[0]}`") if dict(df.dtypes)[order[0]] == "string" else _number(df, order[0]),
                "__nan": _not_a_number(df, order[0]),
                "__tie": _tie(df, order),
            }
        )
        .withColumn("__cell", _count_at_most(x, cuts.points, 0, count))
        .withColumn("__low", F.element_at(points, F.greatest(cell, F.lit(1))))
        .withColumn("__high", F.element_at(points, F.least(cell + 1, F.lit(count))))
        .withColumn(SEGMENT, F.when(F.col(HOT), number).otherwise(0).cast("bigint"))
        .drop("__x", "__nan", "__tie", "__cell", "__low", "__high")
    )


def _tie(df: DataFrame, order: list[str]) -> Column:
    """The second order column as a number, or nothing to cut ties by. Not a number counts as last."""
    if len(order) == 1 or not _splits_ties(df, order):
        return F.lit(0)
    last = F.lit(float("inf"))
    return F.when(_not_a_number(df, order[1]), last).otherwise(_number(df, order[1]))


def _count_at_most(x: Column, cuts: list, start: int, end: int) -> Column:
    """How many of the sorted cut points are at most ``x``, by halving."""
    if start == end:
        return F.lit(start)
    middle = (start + end) // 2
    return F.when(x < F.lit(cuts[middle]), _count_at_most(x, cuts, start, middle)).otherwise(
        _count_at_most(x, cuts, middle + 1, end)
    )


def _step(x: Column, low: Column, high: Column, steps: Column) -> Column:
    share = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    inside = F.when((share > 0) & (share < 1), F.floor(share * steps)).when(share >= 1, steps - 1)
    return F.least(F.coalesce(inside, F.lit(0)), steps - 1).cast("bigint")


def _splits_ties(df: DataFrame, order: list[str]) -> bool:
    """Whether rows equal in the number of the first column are equal in the column itself."""
    types = dict(df.dtypes)
    exact = types[order[0]] in (*INTEGERS, *FLOATS, "date", "timestamp", "timestamp_ntz", "string", "boolean")
    return exact and _is_number(types[order[1]])


def _is_number(dtype: str) -> bool:
    return dtype in (*INTEGERS, *FLOATS, "date", "timestamp", "timestamp_ntz", "boolean", "string") or dtype.startswith(
        "decimal"
    )


def _number(df: DataFrame, name: str) -> Column:
    dtype = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if dtype in INTEGERS:
        return c.cast("bigint")
    if dtype == "date":
        return F.unix_date(c).cast("bigint")
    if dtype == "timestamp":
        return F.unix_micros(c)
    if dtype == "timestamp_ntz":
        return ntz_micros(c)
    if dtype in FLOATS:
        return F.when(~F.isnan(c), c.cast("double"))
    if dtype.startswith("decimal"):
        return c.cast("double")
    if dtype == "boolean":
        return c.cast("bigint")
    if dtype == "string":
        return _text_number(c)
    raise ValueError(f"cannot cut groups along {name}: {dtype} is not a number, date, timestamp, boolean or text")


def _text_number(c: Column) -> Column:
    """The first six bytes of a text as a number that never falls along the order of texts."""
    head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _not_a_number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] not in FLOATS:
        return F.lit(False)
    return F.coalesce(F.isnan(F.col(f"`{name}`")), F.lit(False))


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session time zone."""
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return (seconds + F.minute(c) * 60) * 1_000_000 + micros
