"""SimHash near-duplicates: fingerprints of word shingles, compared in bit slices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.common import stash
from strandline.llm.components import local_roots, roots
from strandline.llm.texts import raw

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
HASHES = 65_536  # hashes of one text held at once
PART = 1024  # fingerprints of one bucket that are compared with one another at once
ENTRIES = 1 << 17  # comparisons of a fingerprint with 64 others held at once
TASK = 250_000  # rows that a task sorts
FULL = 256  # a bucket should hold no more fingerprints than this on average: four lanes

_ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles: a bit is set where more than half of their hashes have it.

    A-Z are lower-cased, words are parted by ASCII white space. Fewer words than a shingle count as one
    shingle; without words it is 0. Shingles are hashed some at a time, so memory does not grow with their number.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    many = max(1, len(words) - shingle + 1)
    stops = (starts + sizes)[-many:].tolist()
    starts = starts[:many].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(
        np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + HASHES], stops[at : at + HASHES])], np.uint64)
        for at in range(0, many, HASHES)
    )


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes in ``parts`` have."""
    counts, many = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
        many += len(hashes)
    return int(np.packbits(2 * counts > many, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key``, a hash of the text and ``print``, the fingerprint as a signed bigint, of every row. A null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, starts, ends = raw(part.column("body"))
            found = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(starts, ends)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("hash"), pa.array(found.view(np.int64))], ["key", "hash", "print"])

    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("body"))
    return narrow.mapInArrow(hashed, f"key {narrow.schema['key'].dataType.simpleString()}, hash long, print long")


def bucket_masks(count: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits such that two fingerprints within ``radius`` agree on all bits of one at least.

    The bits are cut into blocks, ``radius`` of which can differ, so the masks are all choices of the
    others. More blocks make more masks of more bits each; as many are taken as keep buckets of
    ``count`` fingerprints small on average.
    """
    for blocks in range(radius + 1, 2 * radius + 1):
        same = blocks - radius
        if count / 2 ** (BITS * same / blocks) <= FULL:
            break
    edges = [BITS * n // blocks for n in range(blocks + 1)]
    parts = [(1 << edges[n + 1]) - (1 << edges[n]) for n in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, same)]


def close(prints: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same bucket whose fingerprints differ in at most ``radius`` bits.

    Rows come sorted by bucket. Rows of side 0 are compared with one another, rows of side 1 with those of
    side 2 only. Up to 64 fingerprints of a bucket share a lane: plane ``b`` holds bit ``b`` of all of them in
    one word. A fingerprint meets a lane by adding, plane by plane, where they differ to bitwise counters
    with carries; after every eighth plane the lanes in which all have passed the radius are left.
    """
    n = len(prints)
    if n < 2:
        return
    opens = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(opens, n))
    place = np.arange(n) - np.repeat(opens, sizes)
    lanes = -(-sizes // 64)
    lane_of = np.repeat(np.cumsum(lanes) - lanes, sizes) + place // 64
    lane_rows = np.flatnonzero(np.concatenate([[True], lane_of[1:] != lane_of[:-1]]))
    spot = (place % 64).astype(np.uint64)
    one = np.uint64(1)
    planes = [np.add.reduceat((prints >> np.uint64(b) & one) << spot, lane_rows) for b in range(BITS)]
    there = np.add.reduceat(one << spot, lane_rows)
    second = np.add.reduceat((side == 2).astype(np.uint64) << spot, lane_rows)
    last_lane = np.repeat(np.cumsum(lanes), sizes)
    ahead = last_lane - lane_of  # lanes from a row's own to the last of its bucket
    alone = np.repeat(sizes, sizes) == 1
    ahead[alone] = 0
    upto = np.cumsum(ahead)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, "right")))
        row = np.repeat(np.arange(at, to), ahead[at:to])
        lane = lane_of[row] + np.arange(len(row)) - np.repeat(np.cumsum(ahead[at:to]) - ahead[at:to], ahead[at:to])
        own = lane == lane_of[row]
        alive = there[lane] & np.where(own, _ALL << spot[row] << one, _ALL)
        alive &= np.where(side[row] == 0, _ALL, np.where(side[row] == 1, second[lane], ~second[lane]))
        query = prints[row]
        counters = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(row), np.uint64)
        for b in range(BITS):
            carry = planes[b][lane] ^ (np.uint64(0) - (query >> np.uint64(b) & one))
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if b % 8 == 7:
                alive &= ~(over | _above(counters, radius))
                keep = np.flatnonzero(alive)
                if len(keep) < len(row):
                    row, lane, query, alive, over = row[keep], lane[keep], query[keep], alive[keep], over[keep]
                    counters = [c[keep] for c in counters]
            if not len(row):
                break
        if len(row):
            hit = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(hit)
            yield row[which], lane_rows[lane[which]] + bit
        at = to


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the number that the counters hold is above ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) that join the same fingerprints as all pairs within ``radius`` do."""
    return _bucketed(prints, radius, _spanning).distinct()


def neighbours(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each fingerprint, ``a``, some that are within ``radius`` of it, ``b``: the smallest of each bucket, if it is not the smallest itself.

    A bucket with more than ``PART`` is dealt into parts, and only those of a part meet, so work is in proportion to the
    fingerprints however many are close. A caller that needs all pairs finds the others in another way.
    """
    return _bucketed(prints, radius, _smallest, False, TASK).distinct()


def _bucketed(prints: DataFrame, radius: int, found: Callable[[pa.RecordBatch, list[str], int], pa.RecordBatch], across: bool = True, task: int | None = None) -> DataFrame:
    """What ``found`` gives for the buckets of fingerprints that may be within ``radius``.

    ``prints`` has distinct fingerprints, ``print``. Each goes to a bucket for every mask. A bucket with more
    than ``PART`` is dealt into parts, and, if ``across``, every two parts meet in a group of their own, so no task
    holds more than two parts of it at once and no pair is missed. Each group gives fewer links than it has
    fingerprints. With many masks a task may be told how many rows to sort, so that its memory does not grow with the table.
    """
    count = prints.count()
    masks = bucket_masks(count, radius)
    keys = F.array(*(F.struct(F.lit(n).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits")) for n, m in enumerate(masks)))
    dealt = prints.select("print", F.explode(keys).alias("at")).select("print", "at.mask", "at.bits")
    sizes = dealt.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    parts = stash(sizes.select("mask", "bits", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "large-buckets")
    whole = dealt.join(parts, ["mask", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    met = whole.withColumn("part", part)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if across else F.col("part"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    met = met.select("mask", "bits", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), side.cast("byte").alias("side"), "print")
    group = ["mask", "bits", "low", "high"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in batches:
            rest, ready = _whole_groups(part if rest is None else pa.concat_batches([rest, part]), group)
            if ready.num_rows:
                yield found(ready, group, radius)
        if rest is not None and rest.num_rows:
            yield found(rest, group, radius)

    spread = met.repartition(max(1, -(-count * len(masks) // task)), *group) if task else met.repartition(*group)
    sorted_ = spread.sortWithinPartitions(*group)
    return sorted_.mapInArrow(compared, "a long, b long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def _edges(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Where a group differs from the row before."""
    changed = np.zeros(batch.num_rows, bool)
    for name in group:
        values = batch.column(name).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return changed


def _whole_groups(batch: pa.RecordBatch, group: list[str]) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The last group, which the next batch may go on with, and the groups before it."""
    opens = np.flatnonzero(_edges(batch, group))
    cut = int(opens[-1]) if len(opens) else 0
    return batch.slice(cut), batch.slice(0, cut)


def _spanning(batch: pa.RecordBatch, group: list[str], radius: int) -> pa.RecordBatch:
    bucket = np.cumsum(_edges(batch, group))
    prints = batch.column("print").to_numpy().view(np.uint64)
    side = batch.column("side").to_numpy()
    found = np.arange(len(prints))
    for a, b in close(prints, bucket, side, radius):
        fresh = found[a] != found[b]
        found = local_roots(len(prints), np.concatenate([np.arange(len(prints)), a[fresh]]), np.concatenate([found, b[fresh]]))
    child = np.flatnonzero(found != np.arange(len(prints)))
    signed = prints.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[found[child]])], ["a", "b"])


def _smallest(batch: pa.RecordBatch, group: list[str], radius: int) -> pa.RecordBatch:
    prints = batch.column("print").to_numpy()
    least = prints.copy()
    for a, b in close(prints.view(np.uint64), np.cumsum(_edges(batch, group)), batch.column("side").to_numpy(), radius):
        np.minimum.at(least, a, prints[b])
        np.minimum.at(least, b, prints[a])
    near = np.flatnonzero(least != prints)
    return pa.RecordBatch.from_arrays([pa.array(prints[near]), pa.array(least[near])], ["a", "b"])


def near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of every row and the group of rows it belongs to.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    key reachable over links, the row's own included. Returns ``key``, ``fingerprint`` (16 hexadecimal
    digits) and ``component_id``. No other column is read.

    Fingerprints are computed once and kept, with the keys, in the shared scratch folder. Equal ones are
    brought together first, so a group of copies is one fingerprint however many it has. Adaptive
    execution splits such a group where its rows learn their component.

    Texts without words have fingerprint 0 and are linked like any other. Repeated rows get the same
    component. A null key is left out when the smallest is sought; a component of null keys has a null id. An
    empty table gives an empty result.
    """
    found = _grouped(docs, radius, shingle, key, text)
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, radius: int, shingle: int, key: str, text: str) -> DataFrame:
    """``key``, ``hash`` and ``print`` of every row, the ``root`` print of its component and the ``component_id``."""
    given = stash(fingerprints(docs, key, text, shingle), "prints")
    distinct = stash(given.groupBy("print").agg(F.min("key").alias("first")), "distinct-prints")
    stars = stash(roots(links(distinct.select("print"), radius)), "stars").withColumnRenamed("node", "print")
    joined = distinct.join(stars, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = stash(joined.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = stash(joined.join(lowest, "root").select("print", "root", "component_id"), "components")
    return given.join(named, "print")


def first_of_each(docs: DataFrame, grouped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one for each ``root`` of ``grouped``: that with the smallest key.

    ``grouped`` has ``key``, the ``hash`` of the text and ``root`` of every row. Null keys are largest. Of rows with that
    key the one with the smallest hash of its text stays, and one of rows alike in both. Texts are shuffled once, to
    meet the rows that stay.
    """
    place = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    stay = grouped.groupBy("root").agg(F.min(place).alias("best"))
    stay = stash(stay.select(F.struct(F.col("best.key").alias("k"), F.col("best.hash").alias("h")).alias("name")), "stay")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    named = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("name"), row)
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.lit(0)))
    return named.join(stay, "name", "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
