"""Repeated passages: windows of words counted exactly, brought together by super-k-mers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import stash
from strandline.llm.texts import raw, runs

WINDOW = 35
SEED_WORDS = 4  # a minimiser is the least hash of so many consecutive words in a window
BUCKET_BYTES = 24 << 20  # super-k-mer text that one group should hold
BUCKETS_PER_PARTITION = 2
SLICE = 2 << 20  # bytes of text handled in one go
SENT_BYTES = 24 << 20  # super-k-mer text that a task holds before it packs it
SPANS_HELD = 100_000  # spans that a task holds before it packs them
SAMPLE_DOCS, SAMPLE_EVERY = 20_000, 1000  # so many documents are looked at for common windows and minimisers, or one in so many, if that is more
COMMON_TIMES = 8  # a minimiser found so often in the sample may have common windows
MOST_COMMON, MOST_KNOWN = 10_000, 200_000  # such minimisers, and windows of theirs, that every task is told of
HOT_BYTES = BUCKET_BYTES // 4  # estimated text of a minimiser beyond which its runs are cut again
CELL_BITS = 22  # minimisers are counted in so many cells, a power of two; one bit of each is told to every task

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = (np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

KIND_RUNS, KIND_SPANS = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of consecutive texts: ``line`` has them with one space after each, ``at`` where each begins (and the end)."""

    def __init__(self, text: np.ndarray, firsts: np.ndarray):
        solid = ~_SPACE[text]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inside = firsts[firsts < len(text)]
        begins[inside] = solid[inside]
        found = np.flatnonzero(begins)
        word = (np.cumsum(begins) - 1)[solid]
        letters = text[solid]
        self.count = len(found)
        offsets = np.append((np.cumsum(solid) - 1)[found], len(letters)) if len(found) else np.zeros(1, np.int64)
        line = np.full(len(letters) + self.count, 32, np.uint8)
        line[np.arange(len(letters)) + word] = letters
        self.line = line.tobytes()
        self.at = offsets + np.arange(self.count + 1)
        self.doc = np.searchsorted(firsts, found, "right") - 1
        if self.count:
            place = (np.arange(len(letters)) - offsets[word]) % len(_PLACES)
            self.hash = _mix(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _PLACES[place], offsets[:-1]))
        else:
            self.hash = np.zeros(0, np.uint64)


def _grams(words: Words) -> np.ndarray:
    """A hash of each ``SEED_WORDS`` consecutive words."""
    count = words.count - SEED_WORDS + 1
    found = np.zeros(count, np.uint64)
    for k in range(SEED_WORDS):
        found += words.hash[k : k + count] * _PLACES[7 * k + 3]
    return _mix(found)


def _least(grams: np.ndarray) -> np.ndarray:
    """The least gram of each window."""
    least, span, width = grams, 1, WINDOW - SEED_WORDS + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def super_kmers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a minimiser: each run's first window, how many windows, and the minimiser.

    A window is ``WINDOW`` words of one text, named by its first word. Equal windows have equal minimisers.
    """
    n = words.count - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _least(_grams(words))
    whole = words.doc[:n] == words.doc[WINDOW - 1 :]
    opens = np.ones(n, bool)
    opens[1:] = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(opens & whole)
    every = np.append(np.flatnonzero(opens | ~whole), n)
    return first, every[np.searchsorted(every, first, "right")] - first, least[first]


def cut_again(grams: np.ndarray, first: int, many: int, least: np.uint64) -> Iterator[tuple[int, int, np.uint64]]:
    """A run of windows cut where their second-least gram changes: first window, how many, and a key of both grams.

    Equal windows have equal keys. Where a window has one gram only, over and over, that is both.
    """
    own = grams[first : first + many + WINDOW - SEED_WORDS]
    second = _least(np.where(own == least, np.uint64(2**64 - 1), own))
    opens = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]]))
    keys = _mix(second[opens] ^ (least * np.uint64(0x9E3779B97F4A7C15)))
    for a, b, key in zip(opens.tolist(), np.append(opens[1:], many).tolist(), keys):
        yield first + a, b - a, key


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """The words of runs of texts, which text each run's texts are, and the number of each one's first word.

    A long text comes in blocks; each starts with the last words of the one before, so that every window
    lies whole in exactly one.
    """
    for a, b in runs(starts, ends, SLICE):
        if b > a + 1 or ends[a] - starts[a] <= SLICE:
            yield Words(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a]), np.arange(a, b), np.zeros(b - a, np.int64)
            continue
        at, tail, number = int(starts[a]), b"", 0
        while at < ends[a]:
            to = min(int(ends[a]), at + SLICE)
            while to < ends[a] and not _SPACE[data[to]]:
                gaps = np.flatnonzero(_SPACE[data[to : min(int(ends[a]), to + SLICE)]])
                to = to + int(gaps[0]) if len(gaps) else min(int(ends[a]), to + SLICE)
            words = Words(np.frombuffer(tail + data[at:to].tobytes(), np.uint8), np.zeros(1, np.int64))
            yield words, np.array([a]), np.array([number])
            keep = max(0, words.count - WINDOW + 1)
            tail, number, at = words.line[int(words.at[keep]) :], number + keep, to


def _packed(columns: dict[str, pa.Array], bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """The rows of each bucket as one compressed string."""
    order = np.argsort(bucket, kind="stable")
    table = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in columns.values()], list(columns))
    found, opens = np.unique(bucket[order], return_index=True)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for number, a, b in zip(found.tolist(), opens, np.append(opens[1:], len(order))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
            writer.write_batch(table.slice(a, b - a))
        yield number, kind, sink.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted into groups of equal columns: each row's group, each group's size and one row of it."""
    order = np.lexsort(columns[::-1])
    opens = np.ones(len(order), bool)
    opens[1:] = False
    for column in columns:
        opens[1:] |= column[order][1:] != column[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    at = np.flatnonzero(opens)
    return group, np.diff(np.append(at, len(order))), order[at]


@dataclass
class Common:
    """What a sample tells of all documents: windows that are known to repeat, their minimisers, and cells of minimisers with much text."""

    minimisers: np.ndarray
    windows: frozenset[bytes]
    cells: np.ndarray

    def warm(self, least: np.ndarray) -> np.ndarray:
        if not len(self.minimisers):
            return np.zeros(len(least), bool)
        return self.minimisers[np.searchsorted(self.minimisers, least).clip(0, len(self.minimisers) - 1)] == least

    def hot(self, least: np.ndarray) -> np.ndarray:
        cell = least >> np.uint64(64 - CELL_BITS)
        return (self.cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _digests(words: Words, first: int, many: int) -> list[bytes]:
    """128-bit hashes of the words of consecutive windows."""
    line = words.line
    return [xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(words.at[first : first + many].tolist(), (words.at[first + WINDOW : first + many + WINDOW] - 1).tolist())]


def _sent(buckets: int, common: Common):
    """What a task makes of its documents: packed super-k-mers by bucket, and spans of windows known to repeat.

    Windows of a common minimiser that a sample holds twice are settled on the spot; what is left of their runs goes on
    like others. Runs of a minimiser with much text are cut again by the second-least gram and go by both.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = raw(batch.column("body"))
            runs_, held = [], 0
            known: list[tuple[int, int, int]] = []
            for words, texts, number in _blocks(data, starts, ends):
                first, many, least = super_kmers(words)
                if not len(first):
                    continue
                begin = np.searchsorted(words.doc, np.arange(len(texts)))
                warm, hot = common.warm(least), common.hot(least)
                plain = ~(warm | hot)
                first_, many_, key = [first[plain]], [many[plain]], [least[plain]]
                again: list[tuple[int, int, np.uint64]] = []
                for n in np.flatnonzero(warm):
                    seen = np.array([d in common.windows for d in _digests(words, int(first[n]), int(many[n]))])
                    edges = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
                    doc = words.doc[first[n]]
                    for a, b in zip(edges.tolist(), np.append(edges[1:], len(seen)).tolist()):
                        if seen[a]:
                            start = int(first[n]) + a - int(begin[doc]) + int(number[doc])
                            known.append((int(texts[doc]), start, start + b - a + WINDOW - 1))
                        else:
                            again.append((int(first[n]) + a, b - a, least[n]))
                again += [(int(first[n]), int(many[n]), least[n]) for n in np.flatnonzero(hot & ~warm)]
                if again:
                    grams = _grams(words)
                    cut = [c for run in again for c in (cut_again(grams, *run) if common.hot(run[2][None])[0] else [run])]
                    first_.append(np.array([c[0] for c in cut], np.int64))
                    many_.append(np.array([c[1] for c in cut], np.int64))
                    key.append(np.array([c[2] for c in cut], np.uint64))
                first, many, key_ = np.concatenate(first_), np.concatenate(many_), np.concatenate(key)
                doc = words.doc[first]
                own = first - begin[doc] + number[doc]
                line, begins, ends_ = words.line, words.at[first], words.at[first + many + WINDOW - 1] - 1
                runs_.append((key_, texts[doc], own, [line[a:b] for a, b in zip(begins.tolist(), ends_.tolist())]))
                held += int((ends_ - begins).sum())
                if held > SENT_BYTES or len(known) > SPANS_HELD:
                    if rows := [*_packed_runs(batch, runs_, buckets), *_packed_spans(batch, known, buckets)]:
                        yield _batch(rows)
                    runs_, held, known = [], 0, []
            if rows := [*_packed_runs(batch, runs_, buckets), *_packed_spans(batch, known, buckets)]:
                yield _batch(rows)

    return send


def _packed_spans(batch: pa.RecordBatch, known: list[tuple[int, int, int]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Spans of a batch's documents that are settled."""
    if not known:
        return
    row, first, last = (np.array(x, np.int64) for x in zip(*known))
    columns = {c: batch.column(c).take(pa.array(row)) for c in ("r1", "r2")} | {"first": pa.array(first), "last": pa.array(last)}
    yield from _packed(columns, columns["r1"].to_numpy() % buckets, KIND_SPANS)


def _packed_runs(batch: pa.RecordBatch, runs_: list, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Super-k-mers of a batch's documents: their minimisers, documents, first words and texts."""
    if not any(len(texts) for *_, texts in runs_):
        return
    mini, row, start = (np.concatenate([r[n] for r in runs_]) for n in range(3))
    ids = {c: batch.column(c).take(pa.array(row)) for c in ("r1", "r2")}
    texts = pa.chunked_array([pa.array(r[3], pa.binary()) for r in runs_]).combine_chunks()
    columns = {"mini": pa.array(mini), **ids, "start": pa.array(start), "text": texts}
    yield from _packed(columns, (mini % np.uint64(buckets)).astype(np.int64), KIND_RUNS)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    number, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def repeated_windows(texts: list[bytes]) -> np.ndarray:
    """For each window of some super-k-mers, one after another, whether it occurs more than once among them.

    Windows are sorted by a hash of their words' numbers. Neighbours with equal hashes are compared word
    by word; if any are unlike, all are sorted by their words instead.
    """
    units = np.array(list(map(bytes.count, texts, [b" "] * len(texts)))) + 1
    line = b" ".join(texts)
    letters = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(letters == 32)
    offsets = np.concatenate([[0], gaps + 1 - np.arange(1, len(gaps) + 1), [len(letters) - len(gaps)]]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters[letters != 32])])
    number = parts.dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum(units)
    many = units - WINDOW + 1
    at = np.repeat(ends - units - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    code = _mix(number.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(0x9E3779B97F4A7C15) + code[at + k]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    for k in range(WINDOW):
        if not np.array_equal(same, same & (number[at + k][order][1:] == number[at + k][order][:-1])):
            order = np.lexsort([number[at + j] for j in reversed(range(WINDOW))])
            same = np.logical_and.reduce([number[at + j][order][1:] == number[at + j][order][:-1] for j in range(WINDOW)])
            break
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated


def _spans(runs_: pa.Table) -> pa.RecordBatch:
    """The spans of words covered by repeated windows of one bucket's super-k-mers.

    Only minimisers that came twice can have repeated windows, or one whose run has two windows or more: the gram may
    be at several places of one window. They are taken some at a time, so memory is bounded by the largest minimiser.
    """
    mini = runs_["mini"].to_numpy()
    group, counts, _ = _groups(mini)
    size = runs_["text"].combine_chunks()
    long = np.array(pa.compute.count_substring(size, " ")) >= WINDOW
    row = np.flatnonzero((counts[group] > 1) | long)
    row = row[np.argsort(group[row], kind="stable")]
    out = []
    lengths = np.array(pa.compute.binary_length(size.take(pa.array(row))), dtype=np.int64)
    edge = np.flatnonzero(np.concatenate([[True], group[row][1:] != group[row][:-1]])) if len(row) else np.zeros(0, np.int64)
    bytes_at = np.cumsum(lengths) - lengths
    at = 0
    while at < len(edge):
        to = max(at + 1, int(np.searchsorted(bytes_at[edge], bytes_at[edge[at]] + 4 * SLICE, "right")) - 1)
        if to >= len(edge) - 1:
            to = len(edge)
        some = row[edge[at] : edge[to] if to < len(edge) else len(row)]
        texts = size.take(pa.array(some)).to_pylist()
        repeated = repeated_windows(texts)
        many = np.array(list(map(bytes.count, texts, [b" "] * len(texts)))) + 2 - WINDOW
        owner = np.repeat(np.arange(len(some)), many)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        hit = np.flatnonzero(repeated)
        if len(hit):
            first = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)])
            last = np.append(first[1:], True)
            who = some[owner[hit[first]]]
            start = runs_["start"].to_numpy()[who]
            out.append((who, start + offset[hit[first]], start + offset[hit[last]] + WINDOW))
        at = to
    who, first, last = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    taken = runs_.select(["r1", "r2"]).take(pa.array(who))
    return taken.append_column("first", pa.array(first)).append_column("last", pa.array(last))


def _settled(group: pa.Table) -> pa.Table:
    """One bucket: the spans that its super-k-mers have in common with others, and those settled before."""
    kind = group["kind"].to_numpy()
    blobs = group["blob"].combine_chunks()
    of = lambda k: [b.as_py() for b in blobs.take(pa.array(np.flatnonzero(kind == k)))]
    found = [SPANS.empty_table()]
    if found_runs := of(KIND_RUNS):
        found.append(_spans(_unpacked(found_runs)))
    if spans := of(KIND_SPANS):
        found.append(_unpacked(spans))
    return pa.concat_tables(f.cast(SPANS) for f in found)


SPANS = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _common(given: DataFrame, docs: int) -> Common:
    """What a sample of documents, picked by a hash, tells of common windows and minimisers.

    It decides how windows travel, not which are found: a window that the sample holds twice does repeat, and
    runs may be cut anywhere that equal windows agree on. Minimisers are counted in ``2 ** CELL_BITS`` cells, so that the answer is bounded at any size; those
    that share a cell are cut more than they need to be.
    """
    every = max(1, min(SAMPLE_EVERY, docs // SAMPLE_DOCS))
    sample = (given.where(F.pmod(F.col("r1"), F.lit(every)) == 0) if every > 1 else given).select("body")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for words, _, _ in _blocks(*raw(batch.column("body"))):
                first, many, least = super_kmers(words)
                found.append(least)
                sizes.append(words.at[first + many + WINDOW - 1] - words.at[first])
            mini, which, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            size = np.bincount(which, np.concatenate(sizes), len(mini)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(n), pa.array(size)], ["mini", "n", "size"])

    counts = stash(sample.mapInArrow(counted, "mini long, n long, size long").groupBy("mini").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "minimisers")
    top = counts.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "mini").limit(MOST_COMMON).collect()
    minimisers = np.sort(np.array([r["mini"] for r in top], np.int64).view(np.uint64))
    cell = F.shiftrightunsigned("mini", 64 - CELL_BITS)
    full = counts.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")).where(F.col("size") * every > HOT_BYTES)
    bits = full.groupBy(F.expr("cell div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 32))")).alias("bits"))
    cells = np.zeros(2**CELL_BITS // 32, np.uint32)
    for r in bits.collect():  # a row 32 cells at most
        cells[r["word"]] = r["bits"]
    common = Common(minimisers, frozenset(), cells.view(np.uint8))
    if not len(minimisers):
        return common

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _, _ in _blocks(*raw(batch.column("body"))):
                first, many, least = super_kmers(words)
                found = [d for n in np.flatnonzero(common.warm(least)) for d in _digests(words, int(first[n]), int(many[n]))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["window"])

    twice = sample.mapInArrow(windows, "window binary").groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = twice.orderBy(F.desc("n"), "window").limit(MOST_KNOWN).select("window").collect()
    return Common(minimisers, frozenset(bytes(r["window"]) for r in best), common.cells)


def repeated_spans(given: DataFrame) -> DataFrame:
    """The spans of words, ``first`` to before ``last``, that repeated windows cover, by document (``r1``, ``r2``).

    ``given`` has ``r1`` and ``r2``, which name a row, and ``body``. Consecutive windows with one minimiser travel as
    one string to the minimiser's bucket; a bucket's strings from a batch are packed together. Buckets
    hold a bounded amount of text: windows of passages that many documents share are known from a sample and stay where they are, and runs of
    minimisers that have much text all the same go by their second-least gram too. There are as many
    partitions as the text asks for.
    """
    known = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    partitions = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_PARTITION * partitions, math.ceil(3 * known[1] / BUCKET_BYTES))
    sent = given.mapInArrow(_sent(buckets, _common(given, known[0])), "bucket long, kind byte, blob binary")
    dealt = sent.repartition(max(partitions, buckets // BUCKETS_PER_PARTITION), "bucket")
    return dealt.groupBy("bucket").applyInArrow(_settled, "r1 long, r2 long, first long, last long")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Every document without the words that lie in a repeated window.

    A window is ``WINDOW`` consecutive words of one text, words being parted by ASCII white space. A window
    is repeated if its words also start anywhere else in the table, the same text included. All windows
    are judged on the texts as given. Returns ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the words left,
    joined by one space) and, with ``with_text``, those words as ``kept``. No other column is read.

    A row is named by two hashes of its key and text. Repeated rows share the name and the spans, which are
    all of their windows. A null text has no words; one with fewer words than a window loses none; an
    empty table gives an empty result. Texts are shuffled once, to meet their spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.lit(1), F.col(key), body).alias("r1"), F.xxhash64(F.lit(2), body, F.col(key)).alias("r2"), body.alias("body")
    )
    spans = repeated_spans(named.select("r1", "r2", "body"))
    spans = spans.groupBy("r1", "r2").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = stash(spans, "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = raw(batch.column("body"))
            found = [_without(data, int(a), int(b), s, with_text) for a, b, s in zip(starts, ends, batch.column("spans").to_pylist())]
            total, removed, digest, kept = zip(*found) if found else ((), (), (), ())
            arrays = [batch.column("key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            arrays += [pa.array([b"".join(k) for k in kept], pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    joined = named.join(spans, ["r1", "r2"], "left").select("key", "body", "spans")
    kind = joined.schema["key"].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _without(data: np.ndarray, start: int, end: int, spans: list | None, keep: bool) -> tuple[int, int, str, list[bytes]]:
    """The words of a text, those removed, the digest of the rest and, if asked for, the rest; slice by slice."""
    digest, kept, total, left = hashlib.sha256(), [], 0, 0
    merged: list[list[int]] = []
    for span in spans or ():
        if merged and span["first"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span["last"])
        else:
            merged.append([span["first"], span["last"]])
    n = 0
    while start < end:
        to = min(end, start + SLICE)
        while to < end and not _SPACE[data[to]]:
            gaps = np.flatnonzero(_SPACE[data[to : min(end, to + SLICE)]])
            to = to + int(gaps[0]) if len(gaps) else min(end, to + SLICE)
        words = data[start:to].tobytes().split()
        parts, at = [], 0
        while n < len(merged) and merged[n][0] < total + len(words):
            first, last = merged[n]
            parts += words[at : max(at, first - total)]
            at = min(len(words), last - total)
            if last > total + len(words):
                break
            n += 1
        parts += words[at:]
        if parts:
            piece = b" " * (left > 0) + b" ".join(parts)
            digest.update(piece)
            if keep:
                kept.append(piece)
            left += len(parts)
        total += len(words)
        start = to
    return total, total - left, digest.hexdigest(), kept
