"""Tables in which over a third of the rows have no id, or are repeats of one row."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, mixing, packing, sharding

ROWS = 6000


@pytest.fixture(scope="module")
def docs(spark):
    key = F.when(F.col("n") % 5 < 2, None).when(F.col("n") % 5 == 2, 7).otherwise(F.col("n"))
    text = F.when(F.col("n") % 5 == 2, "one row again").otherwise(F.concat_ws(" ", F.lit("row"), F.col("n"), F.repeat(F.lit("x "), (F.col("n") % 9).cast("int"))))
    rows = spark.range(ROWS, numPartitions=8).withColumnRenamed("id", "n")
    return rows.select(key.alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), F.col("n") % 2).alias("source"))


def test_pieces_of_the_order_stay_small(docs, split_groups):
    given = docs.select(F.col("doc_id").alias("key"), "source", "text")
    rows, line = common.shuffled(given, 3, "test-order")
    assert rows == ROWS and line.columns == ["key", "source", "text", "order"]
    sizes = line.groupBy(common.piece_of(F.col("order"), 12).alias("piece")).count().collect()
    assert sum(r["count"] for r in sizes) == ROWS
    assert max(r["count"] for r in sizes if r["piece"] is not None) < ROWS / 3
    none = line.where("key IS NULL").groupBy(common.piece_of(F.col("order"), 12).alias("piece")).count().collect()
    assert len(none) == 12 and max(r["count"] for r in none) < 2 * min(r["count"] for r in none)


def test_ids_that_are_not_hot_keep_their_order(docs, split_groups):
    given = docs.select(F.col("doc_id").alias("key"), "text").where("key <> 7")
    _, line = common.shuffled(given, 3, "test-order")
    assert line.where(F.col("order") != common.shuffle_key(3, F.col("key"))).count() == 0


def test_shards(docs, split_groups):
    found = sharding.interleave(docs, 16, keep=("text",)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in found) == sorted(repr((r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect())
    for s in range(16):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) == ROWS / 16


def test_mix(docs, split_groups):
    size = common.word_count("text")
    found = mixing.fair_queue(docs, size).collect()
    assert len(found) == ROWS
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.fair_queue(docs, size).collect()))
    taken, target = {}, {}
    for r in found:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        target[r["source_size"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 24 for s in taken)


def test_packing_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(found) == ROWS
    groups = {}
    for r in found:
        if r["doc_id"] == 7:
            groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(groups) > 1 and max(groups.values()) < ROWS / 5
