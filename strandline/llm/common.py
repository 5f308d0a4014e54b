"""What several operators of this package share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strandline.operators.hot import GROUP, counted_groups, dealt
from strandline.sources import written as stash

__all__ = ["WORD", "piece_of", "pieces_for", "shuffle_key", "shuffled", "stash", "text_or_empty", "word_count"]

SPREAD = 2**31 - 1

# A word: anything between ASCII white space. Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"

# Rows that one piece of a cut-up order should hold, and how many pieces there may be at most.
ROWS_PER_PIECE = 500
MOST_PIECES = 65_536


def pieces_for(rows: int) -> int:
    """Into how many pieces to cut an order over ``rows`` rows."""
    return min(MOST_PIECES, max(1, math.ceil(rows / ROWS_PER_PIECE)))


def shuffle_key(seed: int, column: Column) -> Column:
    """A seeded, well-mixed sort key of 32 hexadecimal digits; sorting by it shuffles the rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))


def shuffled(given: DataFrame, seed: int, label: str) -> tuple[int, DataFrame]:
    """The number of rows, and ``given`` with its ``shuffle_key`` by ``key`` as ``order``, written to the shared scratch folder.

    Rows of one key stand together, but for a key that ``counted_groups`` finds hot, as missing ids may be: those rows are shuffled
    by their other columns and their partition too, so that no piece of the order fills with them.
    """
    rows, hot = counted_groups(given.select("key"), ["key"])
    order = shuffle_key(seed, F.col("key"))
    if hot is None:
        return rows, stash(given.withColumn("order", order), label)
    # At most as many rows as counted_groups allows.
    hot = F.broadcast(hot.select(F.col(GROUP)["key"].alias("hot_key"), F.lit(True).alias("hot")))
    spread = shuffle_key(seed, F.concat_ws(":", F.col("key").cast("string"), F.col("spread").cast("string")))
    marked = given.withColumn("spread", dealt(given, F.lit(SPREAD))).join(hot, F.col("key").eqNullSafe(F.col("hot_key")), "left")
    return rows, stash(marked.withColumn("order", F.when(F.col("hot"), spread).otherwise(order)).select(*given.columns, "order"), label)


def piece_of(key: Column, pieces: int) -> Column:
    """The piece of a ``shuffle_key``, rising with the key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * F.lit(pieces) / F.lit(2**32)).cast("bigint")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str) -> Column:
    """The number of words of a text; a null text has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("bigint")
