"""Exact deduplication: a Bloom filter names the hashes that may repeat, and only their rows move."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import stash, text_or_empty

# The filter has this many cells a row, but no more than fit a broadcast: 2**28 cells are at most
# 2**22 words of 64 bits, 64 MB.
CELLS_PER_ROW = 16
MOST_CELLS = 2**28
LEAST_CELLS = 2**16


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else. ``lower`` does that, and faster, where all is ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def repeat_filter(hashes: DataFrame, rows: int) -> DataFrame:
    """First pass: a Bloom filter of the hashes that may occur more than once.

    ``hashes`` has one bigint column, ``hash``. A hash falls into one cell; a cell hit twice or more is
    set. Hits are added up per task before the shuffle. Returns the set cells as 64-bit words:
    ``word`` (which) and ``bits``, words without a set cell left out; at most ``MOST_CELLS / 64`` rows.
    """
    cells = cells_for(rows)
    hits = hashes.select(F.pmod("hash", F.lit(cells)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    bit = F.expr("shiftleft(1L, int(cell % 64))")
    return hits.where("n > 1").groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def cells_for(rows: int) -> int:
    """A power of two of cells for ``rows`` rows, within the bounds above."""
    return min(MOST_CELLS, max(LEAST_CELLS, 2 ** math.ceil(math.log2(max(1, rows) * CELLS_PER_ROW))))


def marked(df: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Second pass: ``df`` (with ``hash``) and whether its hash ``repeats``, as the filter has it.

    Rows do not move: the filter is broadcast, its size being bounded whatever the table's. Beyond
    ``MOST_CELLS / CELLS_PER_ROW`` rows more hashes seem to repeat, so more rows move later; results
    stay the same.
    """
    cells = cells_for(rows)
    cell = F.pmod("hash", F.lit(cells))
    probe = df.withColumn("word", F.floor(cell / F.lit(64)).cast("bigint")).withColumn("cell", (cell % 64).cast("int"))
    joined = probe.join(F.broadcast(found), "word", "left")
    hit = F.expr("coalesce(shiftright(bits, cell) & 1L, 0L) = 1L")
    return joined.withColumn("repeats", hit).drop("word", "cell", "bits")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which rows hold equal texts and which of them stays.

    Texts are equal when identical after lower-casing A-Z; a null text equals an empty one. Of equal
    texts the row with the largest ``key`` stays (null keys are smallest); of rows with that key too,
    one stays. Returns a row per row: ``key``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``. No other column is read. An empty table gives an empty result.

    Texts are read once and replaced by their SHA-256, by which they are compared; the narrow rows go to
    the shared scratch folder. Rows whose hash the filter does not name pass straight through. The
    others are added up per text (per task first) and joined with their group; adaptive execution
    splits a group that fills one side of the join.
    """
    norm = ascii_lower(text_or_empty(text))
    given = docs.select(F.col(key).alias("key"), norm.alias("norm")).select(
        "key", F.xxhash64("norm").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")
    )
    given = stash(given, "copies")
    rows = given.count()
    split = marked(given, repeat_filter(given.select("hash"), rows), rows)
    moved = split.where("repeats").drop("repeats")
    best = F.max(F.struct("key", "row"))
    groups = moved.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("sha", "group_size", F.col("best.key").alias("keep_id"), F.col("best.row").alias("keep_row"))
    groups = stash(groups, "copy-groups")  # read from a table, the join is one that adaptive execution can split
    joined = moved.join(groups, "sha", "left").select(
        "key",
        F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        "sha",
    )
    alone = split.where("NOT repeats").select(
        "key", F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(joined).select(
        F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one for each text: that with the largest ``key``.

    Equality is that of ``copies``; of rows with the same key, the text with the largest hash stays. Only rows whose
    hash may repeat are shuffled, and each task sends at most one row a text.
    """
    rows = docs.count()
    norm = ascii_lower(text_or_empty(text))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    given = docs.select(F.col(key).alias("key"), F.xxhash64(norm).alias("hash"), norm.alias("norm"), F.xxhash64(text).alias("raw"), whole.alias("whole"))
    found = stash(repeat_filter(docs.select(F.xxhash64(norm).alias("hash")), rows), "repeats")
    split = marked(given, found, rows)
    alone = split.where("NOT repeats").select("whole.*")
    moved = split.where("repeats").select("key", "raw", F.sha2("norm", 256).alias("sha"), "whole")
    best = moved.groupBy("sha").agg(F.max_by("whole", F.struct("key", "raw")).alias("whole"))
    return alone.unionByName(best.select("whole.*"))
