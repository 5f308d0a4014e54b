"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import piece_of, pieces_for, shuffled, stash, word_count

MOST_REPEATS = 3


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` with a ``weight``: the cycle dealt to the sources by code point, the null source last."""
    nth = F.row_number().over(Window.orderBy("none", "source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.pmod(nth - 1, F.lit(len(cycle))) + 1).cast("int"))
    return sources.withColumn("weight", weight)


def fill_targets(sources: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (``total``, ``weight``) with a ``target`` each.

    All totals are shared by weight; a target stops at ``repeats`` times its source's total and what is
    over is shared again until none is above. That ends at one level for all the sources not stopped.
    They are walked from the one that stops first (least cap for its weight): the level before each is
    what is left of the whole for the weights left. It rises as long as sources stop and falls after, so
    the largest is the level where no more stop.
    """
    cap = F.col("total") * F.lit(repeats)
    order = Window.orderBy(cap / F.col("weight"), "none", "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(every) - F.coalesce(F.sum(cap).over(upto), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    leveled = sources.withColumn("level", left / weights)
    level = F.max("level").over(every)
    return leveled.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("level")


def fair_queue(
    docs: DataFrame,
    size: Column,
    seed: int = 4,
    cycle: tuple[int, ...] = (1, 2, 3),
    repeats: int = MOST_REPEATS,
    key: str = "doc_id",
    source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How often a mix of all sources takes each document.

    Each source queues its documents, shuffled by a seeded hash of ``key``, up to ``repeats`` times over.
    A document in a queue has a virtual finish time: the words of the queue up to and with it, divided by
    the source's weight. All queued documents are sorted by it and taken until the budget, the words of
    all documents, is used up; the one that would overrun it and those after it stay out. So sources
    flow in proportion to their weights, and one that has run out leaves its part to the others.

    Returns ``key``, the columns of ``keep``, ``size``, ``source_size``, ``target`` (of the source),
    ``times`` (how often it is taken, at most ``repeats``) and ``taken`` (its words times that). No other
    column is read. A source's words miss its target by about one document.

    The order within sources is cut into pieces by the hash, so a source with a third of all rows is
    spread, and so is a key, null ones too; words are summed per piece, then over pieces. The sorted order is cut into equal stretches
    of virtual time; their sums tell in which stretch the budget ends, and only that one is sorted. The
    rows, without texts, are written to the shared scratch folder once. Per-source tables have a row a
    source and are put in order by one task.

    A null source is a source of its own, last in the order. A document without words is taken 0 times.
    Rows with the same key in a source are ordered by ``size`` and the kept columns; rows alike in all
    are interchangeable. An empty table gives an empty result, words being zero gives zero targets.
    """
    given = docs.select(
        F.col(key).alias("key"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        size.cast("bigint").alias("size"),
        F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
    )
    rows, given = shuffled(given, seed, "mix")
    pieces = pieces_for(rows)
    given = given.withColumn("piece", piece_of(F.col("order"), pieces))

    stratum = ["none", "source"]
    sums = given.groupBy(*stratum, "piece").agg(F.sum("size").alias("words"))
    totals = sums.groupBy(*stratum).agg(F.sum("words").alias("total"))
    plan = stash(fill_targets(cycle_weights(totals, cycle), repeats), "mix-plan")
    ahead = Window.partitionBy(*stratum).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(*stratum, "piece", (F.sum("words").over(ahead) - F.col("words")).alias("start")).join(plan, stratum)
    within = Window.partitionBy(*stratum, "piece").orderBy("order", "key", "size", F.xxhash64("kept"))
    queued = (
        given.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, [*stratum, "piece"])
        .withColumn("upto", F.col("start") + F.col("upto"))
        .select("key", *stratum, "order", "kept", "size", "upto", "total", "weight", "target")
    )
    queued = stash(queued, "mix-queue")

    edge = _end_of_budget(queued, plan, repeats, pieces)
    times = F.lit(0)
    for lap in range(repeats):
        place = F.struct(*_place(F.lit(lap)))
        inside = F.lit(True) if edge is None else place < F.struct(*(F.lit(v).cast(t).alias(c) for c, t, v in edge))
        times = times + F.when((F.col("size") > 0) & inside, 1).otherwise(0)
    return (
        queued.withColumn("times", times)
        .withColumn("taken", F.col("size") * F.col("times"))
        .select(
            F.col("key").alias(key),
            *(F.col("kept")[c].alias(c) for c in keep),
            "size",
            F.col("total").alias("source_size"),
            "target",
            "times",
            "taken",
        )
    )


def _place(lap: Column) -> list[Column]:
    """Where a copy stands in the sorted queue of all sources. No two copies with words stand alike."""
    finish = (lap.cast("bigint") * F.col("total") + F.col("upto")) / F.col("weight")
    return [finish.alias("finish"), F.col("none"), F.col("source"), lap.cast("int").alias("lap"), F.col("upto")]


def _end_of_budget(queued: DataFrame, plan: DataFrame, repeats: int, pieces: int):
    """The place of the first copy that overruns the budget, or None where none does."""
    known = plan.agg(F.sum("total").alias("budget"), F.max(F.col("target") / F.col("weight")).alias("level")).first()
    budget, level = known["budget"] or 0, known["level"] or 0.0
    if not budget:
        return None
    laps = queued.where("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    # The budget ends near the level. What is far beyond it shares one stretch.
    copies = laps.select("size", *_place(F.col("lap"))).withColumn(
        "stretch", F.least(F.floor(F.col("finish") * F.lit(pieces / level)), F.lit(4 * pieces))
    )
    flow = copies.groupBy("stretch").agg(F.sum("size").alias("words"))
    passed = flow.withColumn("passed", F.sum("words").over(Window.orderBy("stretch")))
    last = passed.where(F.col("passed") > budget).orderBy("stretch").first()
    if last is None:
        return None
    room = budget - (last["passed"] - last["words"])
    line = Window.orderBy("finish", "none", "source", "lap", "upto").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.where(F.col("stretch") == last["stretch"]).withColumn("run", F.sum("size").over(line))
    first = inside.where(F.col("run") > room).orderBy("run").select("finish", "none", "source", "lap", "upto")
    return [(c, t, v) for (c, t), v in zip(first.dtypes, first.first())]


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``fair_queue`` takes them.

    A document taken twice is there twice. Rows alike in key, source and text share what they are given
    as evenly as can be. Nulls and ties count as in ``fair_queue``: a null text has no words and is not taken, null sources are one
    source. Columns may have any names; an empty table gives an empty result.
    """
    print_ = F.struct(F.col(key).alias("k"), F.col(source).alias("s"), F.xxhash64(F.col(text)).alias("h"))
    labeled = docs.select(print_.alias("print"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    narrow = docs.select(key, source, F.col(text))
    queue = fair_queue(narrow.withColumn("print", F.xxhash64(text)), word_count(text), key=key, source=source, keep=("print", source), **settings)
    given = queue.groupBy(F.struct(F.col(key).alias("k"), F.col(source).alias("s"), F.col("print").alias("h")).alias("print")).agg(
        F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")
    )
    given = stash(given.where("times > 0"), "mix-given")
    nth = F.row_number().over(Window.partitionBy("print").orderBy(F.lit(0)))
    share = F.expr("times div rows") + F.when(F.col("nth") <= F.col("times") % F.col("rows"), 1).otherwise(0)
    return (
        labeled.join(given, "print")
        .withColumn("nth", nth)
        .withColumn("share", share.cast("int"))
        .where("share > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("share"))).alias("copy"))
        .select("row.*")
    )
