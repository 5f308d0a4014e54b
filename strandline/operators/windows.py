"""Window functions that hold up when one group has a large part of all rows.

Order columns sort ascending with nulls first; negate a column to sort the other way. The first
order column must be a number, date or timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.operators.hot import GROUP
from strandline.operators.joins import own_interval_totals, salted_join
from strandline.operators.scan import HOT, Wanted, drop_segments, find_split, scan
from strandline.sources import written


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str
) -> DataFrame:
    """Number the rows of each group from 1. With no keys, number the whole table."""
    return scan(df, keys, order, Wanted(sums={name: F.lit(1).cast("bigint")}))


def numbered_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 by ``order``, whole: the rows are exchanged once.

    Rows are range-partitioned, sorted and written to the scratch folder with their place in their partition;
    what comes before each partition is a number per partition, added up on the driver. Rows alike in all order columns may lie in
    several partitions and are numbered as they come. An empty table gives an empty result.
    """
    # The row's own place parts a value that very many rows share.
    given = df.withColumn("__own", F.monotonically_increasing_id())
    ranged = given.repartitionByRange(*order, "__own").sortWithinPartitions(*order, "__own").drop("__own")
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, before = [], 0
    for row in sorted(sizes):
        starts += [F.lit(row["part"]).cast("bigint"), F.lit(before).cast("bigint")]
        before += row["n"]
    start = F.create_map(*starts)[part] if starts else F.lit(0).cast("bigint")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, start + within + 1).drop("__at")


def tiles(df: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """Split each group into ``n`` tiles of like size, as NTILE does: larger tiles come first."""
    one = F.lit(1).cast("bigint")
    numbered = scan(df, keys, order, Wanted(sums={"__nth": one}, totals={"__of": one}))
    nth, of = F.col("__nth") - 1, F.col("__of")
    small = F.floor(of / n)
    large_tiles = of % n
    in_large = large_tiles * (small + 1)
    tile = F.when(nth < in_large, F.floor(nth / (small + 1))).otherwise(
        large_tiles + F.floor((nth - in_large) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(name, (tile + 1).cast("int")).drop("__nth", "__of")


def peer_ranks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` of each row in its group.

    Rows of a group with the same order value are peers and rank alike, so peers are counted before
    anything is ordered. The ranks are worked out on one row per peer set and joined back, with the
    rows of a large peer set dealt over many tasks.
    """
    split = find_split(df, keys, [order])
    peers = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__peers"))
    one = F.lit(1).cast("bigint")
    wanted = Wanted(
        sums={"__upto": F.col("__peers"), "__dense": one}, totals={"__of": F.col("__peers")}
    )
    ranked = scan(peers, keys, [order], wanted, split)
    rank = F.col("__upto") - F.col("__peers") + 1
    of = F.col("__of")
    ranked = ranked.select(
        F.struct(*keys, order).alias(GROUP),
        rank.alias("rank"),
        F.col("__dense").alias("dense_rank"),
        F.when(of > 1, (rank - 1) / (of - 1)).otherwise(0.0).alias("percent_rank"),
        (F.col("__upto") / of).alias("cume_dist"),
    )
    peer_set = df.withColumn(GROUP, F.struct(*keys, order))
    return salted_join(peer_set, ranked, [GROUP]).drop(GROUP)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    firsts: dict[str, str] | None = None,
) -> DataFrame:
    """Add values of the row before, the row after and the first row, as output to input name."""
    wanted = Wanted(
        lags={n: F.col(c) for n, c in (lags or {}).items()},
        leads={n: F.col(c) for n, c in (leads or {}).items()},
        firsts={n: F.col(c) for n, c in (firsts or {}).items()},
    )
    return scan(df, keys, order, wanted)


def moving_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: int,
    aggs: dict[str, Column],
    block: int = 100_000,
) -> DataFrame:
    """Aggregates over each row and the ``back`` rows before it.

    Without hot groups this is one window. With them, rows are numbered, a group is cut into blocks
    of ``block`` rows, and the last ``back`` rows of a block are also sent to the next one, where
    they fill the frames of its first rows.
    """
    split = find_split(df, keys, order)
    if split is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back, 0)
        return df.select("*", *(a.over(frame).alias(n) for n, a in aggs.items()))
    block = max(block, back)
    nth = F.col("__nth") - 1
    numbered = scan(
        df, keys, order, Wanted(sums={"__nth": F.lit(1).cast("bigint")}), split, keep=True
    )
    home = F.when(F.col(HOT), F.floor(nth / block)).otherwise(-1)
    sent_on = F.coalesce(F.col(HOT), F.lit(False)) & (nth % block >= block - back)
    copies = F.when(sent_on, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = numbered.select("*", home.alias("__home"), F.explode(copies).alias("__copy"))
    spread = spread.withColumn("__block", F.col("__home") + F.col("__copy"))
    frame = Window.partitionBy(GROUP, "__block").orderBy("__nth").rowsBetween(-back, 0)
    framed = spread.select("*", *(a.over(frame).alias(n) for n, a in aggs.items()))
    own = framed.where(F.col("__copy") == 0)
    return drop_segments(own).drop("__nth", "__home", "__copy", "__block")


def moving_range_sums(
    df: DataFrame, keys: list[str], time: str, id: str, seconds: int, sums: dict[str, Column]
) -> DataFrame:
    """Sums over the rows of the last ``seconds`` up to each row's ``time``, peers included.

    ``time`` is a timestamp without zone, not null, and ``id`` names a row. The sums should be over
    whole numbers or decimals. Gives the keys, the id and the sums. A RANGE window adds up every
    frame anew, so its work grows with rows times frame; here the sums are read off running totals
    at both ends of the frame.
    """
    return own_interval_totals(df, keys, id, time, seconds, sums)
