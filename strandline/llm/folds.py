"""Labelled rows for fitting: a bounded sample, never from the held-out fold."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import shuffle_key

FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether a row is held out: the CRC-32 of its key as text leaves 0 by five. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int, key: str = "doc_id", text: str = "text"):
    """At most ``most`` labelled documents of each class, as rows ``y``, ``body``, ``order``, and each class's share of all.

    Labels come from rows that are not held out; labels that are null or not 0 or 1 are left out, and a
    key labelled twice takes the larger. The sample is the documents with the smallest seeded hashes,
    ``order``, so reruns agree. It is picked from the narrow labels and joined as a broadcast of at most
    ``2 * most`` rows. Of rows that repeat a key that with the smallest hash of its text is taken, so a sample has
    no more rows than keys.
    """
    known = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = shuffle_key(seed, F.col("key"))
    picked = [known.where(F.col("y") == y).orderBy(order, "key").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = sum(counts.values()) or 1
    met = rows.join(F.broadcast(picked[0].unionAll(picked[1])), "key")
    one = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("body"), "body", "y")).alias("least"))
    return one.select("least.y", "least.body", order.alias("order")), {y: counts.get(y, 0) / total for y in (0, 1)}


def within(sizes: list[tuple[str, int, int]], most: int) -> dict[int, str]:
    """For each class the last hash to take, so that all documents up to it have ``most`` entries at most.

    ``sizes`` has each document's hash, class and entries. The classes take turns, each by its smallest hash, and end together; each has
    its first hash at least. Documents of one hash are taken together.
    """
    total: dict[tuple[int, str], int] = Counter()
    for order, y, size in sizes:
        total[y, order] += size
    nth: Counter = Counter()
    line = []
    for y, order in sorted(total):
        line.append((nth[y], y, order))
        nth[y] += 1
    last: dict[int, str] = {}
    sum_ = 0
    for n, y, order in sorted(line):
        sum_ += total[y, order]
        if n and sum_ > most:
            break
        last[y] = order
    return last
