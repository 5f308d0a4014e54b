"""Periodic runs of words: a dictionary of basic factors proposes periods, extension settles them."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.texts import raw, runs

LEAST_LENGTH = 12  # words of a run


def numbered(split: list[list[bytes]]) -> np.ndarray:
    """One number for each word of some texts' words: equal only for equal words of one text."""
    numbers, fresh = [], count()
    for words in split:
        numbers += map(defaultdict(fresh.__next__).__getitem__, words)
    return np.array(numbers, np.int64)


def factors(number: np.ndarray) -> Iterator[np.ndarray]:
    """For each power of two a name for the factor of that length at every place; -1 where it occurs once only.

    Equal factors have equal names. A factor's name is made from those of its halves, so places named -1 stay out of
    all longer ones, and the dictionary ends with the first length at which no factor occurs twice. One more entry, -1,
    stands past the end.
    """
    n, length = len(number), 1
    place, key = np.arange(n), number
    while len(place):
        order = np.argsort(key, kind="stable")
        opens = np.ones(len(order), bool)
        opens[1:] = key[order][1:] != key[order][:-1]
        group = np.cumsum(opens) - 1
        again = np.bincount(group)[group] > 1
        if not again.any():
            return
        names = np.full(n + 1, -1, np.int32)
        names[place[order[again]]] = group[again]
        yield names
        place = np.flatnonzero(names[: max(0, n - 2 * length + 1)] >= 0)
        place = place[names[place + length] >= 0]
        key = names[place].astype(np.int64) << 32 | names[place + length]
        length *= 2


def proposed(names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods, from ``length`` to below twice that, of what may be runs.

    Occurrences of a factor at most half its length apart form an arithmetic progression. A run starts where one
    occurrence of its first factor stands and its period further stands another; would each follow on one in its
    own progression, the words before both were equal and the run began earlier. So one of the two is the first
    of its progression. At most three progressions begin within twice the length on either side.
    """
    place = np.flatnonzero(names >= 0)
    order = np.argsort(names[place], kind="stable")
    place, name = place[order], names[place[order]]
    opens = np.ones(len(place), bool)
    opens[1:] = (name[1:] != name[:-1]) | (2 * (place[1:] - place[:-1]) > length)
    series = np.cumsum(opens) - 1
    first, of = place[opens], name[opens]
    starts, ends = [], []
    for step in (1, 2, 3):
        for sign in (-1, 1):
            other = series + sign * step
            at = np.flatnonzero((other >= 0) & (other < len(first)))
            at = at[of[other[at]] == name[at]]
            pair = place[at], first[other[at]]
            starts.append(np.minimum(*pair))
            ends.append(np.maximum(*pair))
    start, period = np.concatenate(starts), np.concatenate(ends)
    period = period - start
    fit = (period >= length) & (period < 2 * length)
    return start[fit], period[fit]


def found_runs(number: np.ndarray) -> np.ndarray:
    """Start, length and smallest period of every run, by start and period: stretches of at least ``LEAST_LENGTH`` and
    two periods that no neighbour extends. ``number`` may hold many texts, one after another, that share no number.

    A proposal that the word before extends is another's; the rest are extended to the right by ever shorter factors.
    A stretch that is found with several periods keeps the smallest, which divides the others.
    """
    levels, starts, periods = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, names in enumerate(factors(number)):
        levels.append(names)
        start, period = proposed(names, 1 << k)
        least = (start == 0) | (number[start - 1] != number[start - 1 + period])
        starts.append(start[least])
        periods.append(period[least])
    start, period = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    same, end = np.zeros(len(start), np.int64), len(number)
    for k in reversed(range(len(levels))):
        here = levels[k][np.minimum(start + same, end)]
        there = levels[k][np.minimum(start + period + same, end)]
        same += ((here == there) & (here >= 0)).astype(np.int64) << k
    length = period + same
    whole = length >= np.maximum(LEAST_LENGTH, 2 * period)
    start, length, period = start[whole], length[whole], period[whole]
    order = np.lexsort([period, length, start])
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([start, length, period], 1)[fresh]
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, change: Callable[[str | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """The periodic runs of every text and what is left when only the first period of each stays.

    Words are parted by ASCII white space. A run is a stretch of consecutive words with smallest period q (words q
    apart are identical) and at least max(12, 2 * q) words that no neighbouring word extends keeping period q. Returns
    ``key``, ``n_words``, ``runs`` (structs of ``start``, ``length``, ``period``, by start, then period), ``collapsed_sha256``
    (of the words left, joined by one space, in UTF-8; a word goes if any run holds it after that run's first q words)
    and, with ``with_text``, those words as ``collapsed``. ``change``, if given, takes a row's key as text and its words and
    returns the words to judge.

    Each text is judged by itself where it lies: nothing is shuffled. Texts are taken whole, short ones together up to a
    bounded size; memory grows with the longest text, by four bytes a word for each power of two up to the longest factor that repeats.
    A null text has no words, like an empty one. A null key stays null; repeated rows give equal rows; an empty
    table gives an empty result; no other column is read.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = raw(batch.column("body"))
            for a, b in runs(starts, ends):
                split = [data[s:e].tobytes().split() for s, e in zip(starts[a:b], ends[a:b])]
                if change is not None:
                    split = [change(name, words) for name, words in zip(batch.column("name").slice(a, b - a).to_pylist(), split)]
                found = found_runs(numbered(split))
                opens = np.cumsum([0] + [len(w) for w in split])
                edge = np.searchsorted(found[:, 0], opens)
                digests, left = [], []
                for n, words in enumerate(split):
                    own = found[edge[n] : edge[n + 1]] - [opens[n], 0, 0]
                    if len(own):
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, own[:, 0] + own[:, 2], 1)
                        np.add.at(gone, own[:, 0] + own[:, 1], -1)
                        words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
                    rest = b" ".join(words)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    left += [rest] * with_text
                local = found[:, 0] - np.repeat(opens[:-1], np.diff(edge))
                structs = pa.StructArray.from_arrays([pa.array(local), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
                arrays = [
                    batch.column("key").slice(a, b - a),
                    pa.array(np.diff(opens)),
                    pa.ListArray.from_arrays(pa.array(edge, pa.int32()), structs),
                    pa.array(digests, pa.string()),
                ] + [pa.array(left, pa.binary()).cast(pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "n_words", "runs", "collapsed_sha256"] + ["collapsed"] * with_text
    narrow = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("body"))
    kind = f"`{key}` {narrow.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>"
    return narrow.mapInArrow(judged, kind + ", collapsed_sha256 string" + ", collapsed string" * with_text)
