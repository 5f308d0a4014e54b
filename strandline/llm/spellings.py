"""Spelling variants: words one letter apart, found in a trie of letter-group counts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import stash

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_TIMES = 5, 3
LEAST_GROUPS = 8
COMMON = "enisratdhulcgmobwfkzpvéüäöyjèxqßàçêñóíáú"  # letters, roughly by how common they are
BUCKET_WORDS = 20_000  # of one bucket; beyond that the trie's next level parts it
PART_ROWS = 40_000  # words and visitors of the buckets that one task takes
LEAF_PAIRS = 512  # a node with no more pairs of a word and a visitor is a leaf
VERIFIED = 100_000  # pairs that are compared at once
WIDE = 64  # letters; longer words are compared one by one
MOST_ROUNDS = 8  # of doubling: a word's form is at least twice as frequent, so no path has over 63 steps


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[str, str], str] | None = None) -> DataFrame:
    """``word`` and ``n``: how often each run of letters is found, A-Z lower-cased, over all whole texts.

    ``change``, if given, takes a row's key as text and a run and returns what to count in its place. Words of fewer than
    ``LEAST_LETTERS`` are left out, as are those found less than ``LEAST_TIMES``. Each batch of rows is added up before the shuffle.
    A null text has no words; a null key is empty text; an empty table gives an empty result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                own = Counter(RUN.findall(body.encode().lower().decode()))
                if change is None:
                    total.update(own)
                    continue
                for run, n in own.items():
                    total[change(name, run)] += n
            rows = [(w, n) for w, n in total.items() if len(w) >= LEAST_LETTERS]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    given = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return given.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _ranks() -> np.ndarray:
    """For each code point up to U+00FF its place: the common letters first, the rest in their order."""
    ranks = np.full(256, -1)
    rest = [c for c in map(chr, range(256)) if c not in COMMON]
    ranks[[ord(c) for c in [*COMMON, *rest]]] = np.arange(256)
    return ranks


def group_counts(words: list[str], groups: int) -> np.ndarray:
    """For each word how many letters it has, and how many of them in each of ``groups`` letter groups; 255 at most."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    cell = np.repeat(np.arange(len(words)), lengths) * groups + (_ranks() % groups)[letters]
    counts = np.bincount(cell, minlength=len(words) * groups).reshape(-1, groups)
    return np.concatenate([lengths[:, None], counts], 1).clip(0, 255).astype(np.uint8)


def budgets(first: bytes) -> list[bytes]:
    """The beginnings of counts that a word one letter apart may have, ``first`` being those of a word.

    One group may have a letter more, another one fewer, or groups that are not among the first. The whole word has as many letters, or,
    unless one is more and another fewer, one more or one fewer.
    """
    found = set()
    for up in range(len(first)):
        for down in range(len(first)):
            if up and up == down:
                continue
            steps = {(up > 0) - (down > 0)} | ({-1, 1} if up == down == 0 else set()) | ({0} if not (up and down) else set())
            for step in steps:
                other = list(first)
                other[0] += step
                other[up] += up > 0
                other[down] -= down > 0
                if min(other) >= 0:
                    found.add(bytes(min(c, 255) for c in other))
    return sorted(found)


class Letters:
    """Some words, and which pairs of them one inserted, deleted or replaced letter makes equal."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        width = int(self.lengths.max(initial=0).clip(4, WIDE)) + 1
        lines = [w[:WIDE].encode("latin-1") for w in words]
        self.table = np.array(lines, f"S{width}").view(np.uint8).reshape(len(words), width)
        self.ends = [np.array([x[:2] for x in lines], "S2").view(np.uint16), np.array([w[-2:].encode("latin-1") for w in words], "S2").view(np.uint16)]

    def apart_by_one(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of numbers of words whether they are one letter apart."""
        long, wide = self.lengths[left], self.lengths[right]
        # One letter's change leaves two letters at one end alone, in words long enough.
        found = np.minimum(long, wide) < 4
        for end in self.ends:
            found |= end[left] == end[right]
        found &= np.abs(long - wide) <= 1
        at = np.flatnonzero(found)
        short = np.maximum(long[at], wide[at]) <= WIDE
        found[at] = False
        for n in at[~short]:
            found[n] = self._apart(self.words[left[n]], self.words[right[n]])
        at = at[short]
        swap = long[at] > wide[at]
        x, y = self.table[np.where(swap, right[at], left[at])], self.table[np.where(swap, left[at], right[at])]
        unlike = x != y
        many = unlike.sum(1)
        same = long[at] == wide[at]
        found[at[same]] = many[same] == 1
        x, y, unlike = x[~same], y[~same], unlike[~same]
        after = np.logical_or.accumulate(unlike, 1)[:, :-1]  # from the first unlike letter on
        found[at[~same]] = ~((x[:, :-1] != y[:, 1:]) & after).any(1)
        return found

    @staticmethod
    def _apart(x: str, y: str) -> bool:
        x, y = sorted((x, y), key=len)
        at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
        return x != y and (x[at + 1 :] == y[at + 1 :] if len(x) == len(y) else x[at:] == y[at + 1 :])


class Trie:
    """Words by successive letter-group counts. Sorted count vectors are the trie: a node is a stretch with one beginning."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]
        self.depth = counts.shape[1]

    def meet(self, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words and of visitors that may be one letter apart, leaf by leaf, depth first.

        A visitor may have one letter more than a word in one group and one fewer in another. Each level below the first, which has
        the number of all letters, spends what its counts differ by; a visitor that has nothing left to spend goes no further down.
        """
        every = np.arange(len(visitors))
        stack = [(0, len(self.order), 0, every, np.ones(len(every), np.int8), np.ones(len(every), np.int8))]
        while stack:
            low, high, depth, who, surplus, deficit = stack.pop()
            if depth == self.depth or (high - low) * len(who) <= LEAF_PAIRS:
                yield np.repeat(self.order[low:high], len(who)), np.tile(who, high - low)
                continue
            column = self.counts[low:high, depth]
            opens = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            own = visitors[who, depth].astype(np.int16)
            for a, b in zip(opens, np.append(opens[1:], high - low)):
                over = own - int(column[a])
                if depth == 0:
                    fit = np.flatnonzero(np.abs(over) <= 1)
                    stack.append((low + a, low + b, 1, who[fit], surplus[fit] - (over[fit] < 0), deficit[fit] - (over[fit] > 0)))
                    continue
                fit = np.flatnonzero((over == 0) | ((over == 1) & (surplus > 0)) | ((over == -1) & (deficit > 0)))
                if len(fit):
                    stack.append((low + a, low + b, depth + 1, who[fit], surplus[fit] - (over[fit] == 1), deficit[fit] - (over[fit] == -1)))


PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def _verified(letters: Letters, n: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> pa.Table:
    left, right = np.concatenate(left), np.concatenate(right)
    near = letters.apart_by_one(left, right)
    left, right = left[near], right[near]
    columns = [pa.array([letters.words[i] for i in left], pa.string()), pa.array(n[left]), pa.array([letters.words[i] for i in right], pa.string()), pa.array(n[right])]
    return pa.table(columns, schema=PAIRS)


def _near_in(part: pa.Table, groups: int) -> pa.Table:
    """The near pairs of all buckets of a part: of two words at home there, or of one at home and a visitor."""
    part = part.sort_by("bucket").combine_chunks()
    words, n, home = part["word"].to_pylist(), part["n"].to_numpy(), np.array(part["home"])
    bucket = part["bucket"].to_pylist()
    counts, letters = group_counts(words, groups), Letters(words)
    opens = [i for i in range(len(words)) if i == 0 or bucket[i] != bucket[i - 1]]
    found, left, right, held = [], [], [], 0
    for a, b in zip(opens, [*opens[1:], len(words)]):
        at_home = a + np.flatnonzero(home[a:b])
        if not len(at_home) or b - a < 2:
            continue
        for mine, other in Trie(counts[at_home]).meet(counts[a:b]):
            mine, other = at_home[mine], other + a
            fit = (mine < other) | ~home[other]  # two words at home meet twice
            left.append(mine[fit])
            right.append(other[fit])
            held += int(fit.sum())
            if held >= VERIFIED:
                found.append(_verified(letters, n, left, right))
                left, right, held = [], [], 0
    if held:
        found.append(_verified(letters, n, left, right))
    return pa.concat_tables(found) if found else PAIRS.empty_table()


def _by_deletions(visits: DataFrame) -> DataFrame:
    """The near pairs of buckets that no level of the trie parts: words with one letter left out meet.

    Two words one replacement apart are equal without the letter at one place, a longer word without one letter is
    the shorter one. So few words share such a key that a group of them is bounded by the alphabet and the word's length.
    """

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, word in enumerate(batch.column("word").to_pylist()):
                line = word.encode("latin-1")
                keys = [xxhash.xxh3_128_digest(line)] + [xxhash.xxh3_128_digest(line[:i] + line[i + 1 :]) for i in range(len(line))]
                rows = batch.take(pa.array([n] * len(keys)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary()), pa.array(range(-1, len(line)), pa.int32())], names)

    names = ["bucket", "home", "word", "n", "rest", "place"]
    keyed = stash(visits.select(*names[:4]).mapInArrow(shortened, "bucket binary, home boolean, word string, n long, rest binary, place int"), "deletions")
    a, b = keyed.alias("a"), keyed.alias("b")
    here = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.home") | F.col("b.home"))
    replaced = a.join(b, here & (F.col("a.place") == F.col("b.place")) & (F.col("a.place") >= 0) & (F.col("a.word") < F.col("b.word")))
    added = a.join(b, here & (F.col("a.place") == -1) & (F.col("b.place") >= 0))
    pairs = replaced.unionAll(added).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.arange(batch.num_rows)
            letters = Letters(batch.column("a").to_pylist() + batch.column("b").to_pylist())
            yield batch.filter(pa.array(letters.apart_by_one(many, many + batch.num_rows)))

    return pairs.distinct().mapInArrow(checked, "a string, a_n long, b string, b_n long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Every two words of ``vocabulary`` (distinct ``word``, and ``n``) that are one letter apart, once: ``a``, ``a_n``, ``b``, ``b_n``.

    Words have letters up to U+00FF. The trie's upper levels are spread over the cluster: a word is at home in the bucket of
    its first counts and visits the later buckets within its budget, so of two near words in different buckets one visits the other. There are as many
    levels above the buckets as bring the largest down to ``BUCKET_WORDS``. Words whose counts are all alike and more than
    that meet by their deletions instead.
    """
    spark = vocabulary.sparkSession
    groups = max(LEAST_GROUPS, math.ceil(math.log2(max(1, vocabulary.count()))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = group_counts(batch.column("word").to_pylist(), groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in counts], pa.binary())], ["word", "n", "counts"])

    words = stash(vocabulary.select("word", "n").mapInArrow(placed, "word string, n long, counts binary"), "words")
    alike = stash(words.groupBy("counts").agg(F.count(F.lit(1)).alias("n")), "counts")
    levels = alike.select("n", "counts", F.explode(F.sequence(F.lit(1), F.lit(groups + 1))).alias("level"))
    sizes = levels.groupBy("level", F.expr("substring(counts, 1, level)").alias("bucket")).agg(F.sum("n").alias("n"))
    largest = {r["level"]: r["n"] for r in sizes.groupBy("level").agg(F.max("n").alias("n")).collect()}  # a row a level
    level = next((k for k in range(1, groups + 1) if largest.get(k, 0) <= BUCKET_WORDS), groups + 1)

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[bytes]] = {}
        for batch in batches:
            row, bucket, home = [], [], []
            for n, counts in enumerate(batch.column("counts").to_pylist()):
                own = counts[:level]
                later = known.get(own)
                if later is None:
                    later = known[own] = [b for b in budgets(own) if b > own]
                row += [n] * (len(later) + 1)
                bucket += [own, *later]
                home += [True] + [False] * len(later)
            taken = batch.select(["word", "n"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bucket, pa.binary()), pa.array(home, pa.bool_())], ["word", "n", "bucket", "home"])

    visits = stash(words.mapInArrow(visiting, "word string, n long, bucket binary, home boolean"), "visits")
    visited = visits.count()
    shared = alike.groupBy(F.expr(f"substring(counts, 1, {level})").alias("bucket")).agg(F.sum("n").alias("words"))
    visits = visits.join(stash(shared, "buckets"), "bucket")  # buckets where no word is at home fall away
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(visited / PART_ROWS))
    dealt = visits.where(F.col("words") <= BUCKET_WORDS).withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)))
    near = dealt.groupBy("part").applyInArrow(lambda t: _near_in(t, groups), "a string, a_n long, b string, b_n long")
    if largest.get(level, 0) > BUCKET_WORDS:
        near = near.unionByName(_by_deletions(visits.where(F.col("words") > BUCKET_WORDS)))
    return near


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every word of ``forms`` (``word``, ``form``), where forms lead on to the last.

    Paths double in length each round, and each is written to the shared scratch folder.
    """
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stash(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "roots")
        if at.where("open").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("forms lead on without end")


def variants(vocabulary: DataFrame) -> DataFrame:
    """Each word of ``vocabulary`` with its near words and the form it is a variant of.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter. Returns ``word``, ``root`` (from the word,
    forms followed to the last; the word itself if it has none), ``form`` (its near word of largest ``n``, the smallest in code-point order of
    those, if that has at least twice the word's ``n``; else null), ``n``, ``n_near`` and ``form_n``.

    Words come from ``occurrences``: distinct, not null, with letters up to U+00FF; extra columns are not read. Words of any
    length are taken whole. An empty table gives an empty result.
    """
    known = stash(vocabulary.select("word", "n"), "vocabulary")
    pairs = stash(near_pairs(known), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= 2 * F.col("n")
    found = known.join(best, "word", "left").select(
        "word",
        F.when(taken, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    found = stash(found, "variants")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")
