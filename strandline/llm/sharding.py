"""Proportional stratified interleaving: shards that all have the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import piece_of, pieces_for, shuffled, stash


def interleave(
    docs: DataFrame, shards: int = 16, seed: int = 3, key: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Deal rows to shards so that counts differ by at most one and each shard has the whole's mixture.

    Rows are shuffled within their source by a seeded hash of ``key`` and ranked. A row's fractional
    rank, ``(rank - 1/2) / rows of the source``, says how far into its source it stands; sorted by it,
    sources alternate in proportion, and the sorted rows are cut into ``shards`` runs.

    Returns ``key``, the columns of ``keep``, ``shard`` (from 0) and ``slot`` (from 0 in each shard,
    without gaps). No other column is read, so others may have any name.

    Both orders are cut into pieces of bounded size: rows are counted per piece, the counts are summed
    over pieces and only the rows inside a piece are sorted by one task. A source with a third of the
    rows is spread like the rest, and so is a key with as many, null ones too. The rows and then the ranked rows are
    written to the shared scratch folder.

    A null source is a source of its own, sorted last. Null keys count as empty text. Rows with the
    same key and source are ordered by the kept columns; rows alike in all of those get neighbouring
    places in an order that does not matter. An empty table gives an empty result.
    """
    given = docs.select(
        F.col(key).alias("key"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
    )
    rows, given = shuffled(given, seed, "interleave-given")
    pieces = pieces_for(rows)
    given = given.withColumn("piece", piece_of(F.col("order"), pieces))

    stratum = ["none", "source"]
    counts = given.groupBy(*stratum, "piece").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*stratum)
    starts = counts.select(
        *stratum,
        "piece",
        (F.sum("n").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(whole).alias("of"),
    )
    tie = F.xxhash64("key", "kept")
    within = Window.partitionBy(*stratum, "piece").orderBy("order", "key", tie)
    ranked = (
        given.withColumn("nth", F.row_number().over(within))
        .join(starts, [*stratum, "piece"])
        .withColumn("rank", F.col("start") + F.col("nth"))
        .withColumn("share", (2 * F.col("rank") - 1) / (2 * F.col("of")))
        .select("key", *stratum, "kept", "rank", "share", F.least(F.lit(pieces - 1), F.floor(F.col("share") * pieces)).alias("piece"))
    )
    ranked = stash(ranked, "interleave")

    sizes = ranked.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("start"))
    placed = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("piece").orderBy("share", *stratum, "rank")))
    place = F.col("start") + F.col("nth") - 1
    shard = F.floor(place * shards / F.lit(max(rows, 1))) if rows * shards < 2**53 else F.expr(f"(start + nth - 1) * {shards} div {rows}")
    first = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return (
        placed.join(F.broadcast(before), "piece")  # at most MOST_PIECES rows
        .select("key", "kept", place.alias("place"), shard.cast("int").alias("shard"))
        .select(F.col("key").alias(key), *(F.col("kept")[c].alias(c) for c in keep), "shard", (F.col("place") - first).alias("slot"))
    )
