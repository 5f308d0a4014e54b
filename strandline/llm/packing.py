"""Packing tokenized documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from strandline.llm.texts import raw, runs

END = 1
CAPACITY = 2048
GROUP_PIECES = 4096  # about how many pieces are packed together
UNITS_KEPT = 400_000  # units whose ids a worker remembers
LONGEST_KEPT = 64  # bytes of a unit it remembers
SLICE = 4 << 20  # bytes tokenized in one go
MARK = "\x01"  # stands between units handed to the tokenizer together

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER, _POINT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[np.frombuffer(b".,!?;:%$&*#|", np.uint8)] = _POINT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


# How a tokenizer file must treat texts for its ids to be those of single units.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_units(path: str) -> bool:
    """Whether ``UnitIds`` gives the ids of this tokenizer file."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    model = known["model"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    bounded = all(
        a["content"].startswith("<|") and a["content"].endswith("|>") and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])
        for a in known["added_tokens"]
    )
    ended = model["type"] == "BPE" and bool(model.get("end_of_word_suffix"))
    return known["normalizer"] == NORMALIZER and known["pre_tokenizer"] == PRE_TOKENIZER and plain and bounded and ended


class WholeIds:
    """The ids of texts, each handed to the tokenizer whole: right for any tokenizer file."""

    sliced = False

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def of_texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive texts in a row, and how many each text has."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist())]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)


class UnitIds:
    """The ids of texts, by the tokenizer, looked up unit by unit.

    The tokenizer drops white space and splits there, ignores case, and splits letters from points. So a
    text is cut there first, and its ids are those of its units in a row. A worker remembers units while
    there is room. New units are encoded many at a time. Those of lower-case letters only need just the
    tokenizer's model; others get the whole tokenizer, a mark between them; those that are long, hold the
    mark or look like a special token are encoded on their own. That holds for tokenizer files of which ``by_units`` says so.
    """

    sliced = True

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[n for token, n in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.mark = int(self._encode(self.tokenizer, [MARK])[0][0])
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def _encode(tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, units: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.sizes)
        self.place.update(zip(units, range(first, first + len(units))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _learn_letters(self, units: list[bytes]) -> None:
        if not units:
            return
        ids = self._encode(self.model, [b" ".join(units).decode()])[0]
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) == len(units):
            self._add(units, np.diff(stops, prepend=0), ids)
        else:
            self._learn_others(units)

    def _learn_others(self, units: list[bytes]) -> None:
        if not units:
            return
        ids = self._encode(self.tokenizer, [f" {MARK} ".join(u.decode() for u in units)])[0]
        marks = np.flatnonzero(ids == self.mark)
        self._add(units, np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1, np.delete(ids, marks))

    def of(self, units: list[bytes], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``units[n]`` for each ``n`` of ``uses`` in a row, and how many each of them has."""
        if len(self.place) > UNITS_KEPT:
            self.forget()
        letters, others, odd = [], [], []
        for unit in units:
            if unit in self.place:
                continue
            if len(unit) > LONGEST_KEPT or b"\x01" in unit or b"<|" in unit or b"|>" in unit:
                odd.append(unit)
            elif unit.isalpha() and unit.islower():
                letters.append(unit)
            else:
                text = unit.decode()
                plain = text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text)
                (letters if plain else others).append(unit)
        self._learn_letters(letters)
        self._learn_others(others)
        known = len(self.sizes), len(self.ids)
        if odd:
            found = self._encode(self.tokenizer, [u.decode() for u in odd])
            self._add(odd, np.array([len(f) for f in found], np.int64), np.concatenate(found))
        index = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))[uses]
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(total)]
        for unit in odd:
            del self.place[unit]
        self.starts, self.sizes, self.ids = self.starts[: known[0]], self.sizes[: known[0]], self.ids[: known[1]]
        return ids, sizes

    def of_texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive texts in a row, and how many each text has."""
        text = data[int(starts[0]) : int(ends[-1])]
        special = b"<|" in text.tobytes()
        solid = ~_SPACE[text]
        begins = solid.copy()
        if len(text):
            begins[1:] &= ~solid[:-1]
            if not special:
                text = _LOWER[text]
                kind = _KIND[text]
                begins[1:] |= kind[1:] + kind[:-1] == _LETTER + _POINT
            first = starts - starts[0]
            first = first[first < len(text)]
            begins[first] = solid[first]
        at = np.flatnonzero(begins)
        offsets = np.append((np.cumsum(solid) - 1)[at], np.count_nonzero(solid)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text[solid])]).dictionary_encode()
        ids, sizes = self.of(units.dictionary.to_pylist(), units.indices.to_numpy())
        tokens = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(tokens[np.searchsorted(at, np.append(starts, ends[-1]) - starts[0])])


_KNOWN: dict[str, UnitIds | WholeIds] = {}


def _units(path: str) -> UnitIds | WholeIds:
    """A worker's tokenizer, kept between batches."""
    if path not in _KNOWN:
        _KNOWN[path] = (UnitIds if by_units(path) else WholeIds)(path)
    return _KNOWN[path]


def encoded(units: UnitIds | WholeIds, column: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each text of a column: its number, ids of it in order with ``END`` last, and its number of ids.

    A very long text is encoded in slices cut at white space, where the tokenizer's ids do not depend on that.
    """
    data, starts, ends = raw(column)
    for first, last in runs(starts, ends, SLICE):
        if units.sliced and last == first + 1 and ends[first] - starts[first] > SLICE:
            parts = [units.of_texts(data, np.array([a]), np.array([b]))[0] for a, b in _cuts(data, int(starts[first]), int(ends[first]))]
            yield first, np.concatenate([*parts, [np.uint32(END)]])
            continue
        ids, counts = units.of_texts(data, starts[first:last], ends[first:last])
        closed = np.insert(ids, np.cumsum(counts), np.uint32(END))
        stops = np.cumsum(counts + 1)
        for n, (a, b) in enumerate(zip(stops - counts - 1, stops)):
            yield first + n, closed[a:b]


def _cuts(data: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A long text in slices that begin at white space, as nearly of ``SLICE`` bytes as its words allow."""
    while end - start > SLICE:
        at = start + SLICE
        while at < end and not _SPACE[data[at]]:
            gaps = np.flatnonzero(_SPACE[data[at : min(end, at + SLICE)]])
            at = at + int(gaps[0]) if len(gaps) else min(end, at + SLICE)
        yield start, at
        start = at
    if start < end:
        yield start, end


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document as ids, cut into pieces of at most ``CAPACITY``.

    A document is its text's ids by the tokenizer file, whichever it is, and then ``END``; a null text has only that. Each
    id lies in one piece; all pieces but a document's last are full. Returns ``key``, ``start`` (ids
    before it), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers),
    ``doc_tokens`` and, with ``with_ids``, the ids themselves as such bytes. Rows stay where they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(tokenizer)
        for batch in batches:
            rows, kept = [], []
            for n, ids in encoded(units, batch.column("body")):
                ids = np.ascontiguousarray(ids, "<u4")
                for start in range(0, len(ids), CAPACITY):
                    part = ids[start : start + CAPACITY]
                    rows.append((n, start, len(part), zlib.crc32(part), len(ids)))
                    if with_ids:
                        kept.append(part.tobytes())
            columns = np.array(rows, np.int64).reshape(-1, 5)
            arrays = [batch.column("key").take(pa.array(columns[:, 0]))] + [pa.array(columns[:, n]) for n in range(1, 5)]
            arrays += [pa.array(kept, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def least_slack(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """Fill sequences one after another, each as nearly full as what is left allows.

    ``counts`` says how many pieces there are of each length. A sequence starts with the longest piece
    left. Which sums up to the rest of it can be made from the other pieces is a bitset: bit ``s`` is
    set if some multiset of the lengths tried so far adds up to ``s``; a length adds itself by a shift,
    in powers of two of its count. It ends early when the rest itself can be made. The multiset is then
    read back from the bitsets before each step. Yields a multiset and how many sequences in a row get it.
    """
    left = {length: n for length, n in counts.items() if n}
    while left:
        longest = max(left)
        rest = capacity - longest
        window = (2 << rest) - 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= rest), reverse=True):
            n, part = left[length] - (length == longest), 1
            while n > 0 and not reach >> rest & 1:
                part = min(part, n)
                steps.append((length, part, reach))
                reach |= reach << length * part & window
                n -= part
                part *= 2
            if reach >> rest & 1:
                break
        at, chosen = reach.bit_length() - 1, {longest: 1}
        for length, part, before in reversed(steps):
            if not before >> at & 1:
                chosen[length] = chosen.get(length, 0) + part
                at -= length * part
        times = min(left[x] // n for x, n in chosen.items())
        yield chosen, times
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]


def placed(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset in it of each piece."""
    order = np.argsort(lengths, kind="stable")
    found, counts = np.unique(lengths, return_counts=True)
    queues = dict(zip(found.tolist(), np.split(order, np.cumsum(counts)[:-1])))
    used = dict.fromkeys(queues, 0)
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for chosen, times in least_slack(dict(zip(found.tolist(), counts.tolist())), capacity):
        at = 0
        for length, each in chosen.items():
            for _ in range(each):
                some = queues[length][used[length] : used[length] + times]
                sequence[some], offset[some] = n + np.arange(times), at
                used[length] += times
                at += length
        n += times
    return sequence, offset


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` of each.

    Pieces are dealt by a hash to groups of about ``GROUP_PIECES``, each packed by one task, so groups
    stay small whatever the table's size; the partition is hashed too, so that repeated rows are spread. A sequence lies in one group; its id is the group's
    number times 2**32 plus its own number there. A sequence that is not filled is to be padded to
    ``CAPACITY``; about one a group is far from full.

    Empty and null texts take one id each. A very long text is tokenized in bounded slices and cut into pieces. Repeated rows are packed each.
    Columns but ``key`` and ``text`` are not read. An empty table gives an empty result.
    """
    known = docs.select(F.col(text).alias("body")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    groups = max(1, math.ceil((known[0] + known[1] / (3 * CAPACITY)) / GROUP_PIECES))
    cut = pieces(docs, tokenizer, key, text, with_ids)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(key, "start", "ids_crc32", F.spark_partition_id()), F.lit(groups)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(key, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = placed(group["length"].to_numpy())
        number = group["group"].to_numpy() * 2**32 + sequence
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    schema = cut.schema.add("sequence_id", LongType()).add("offset", LongType())
    return dealt.groupBy("group").applyInArrow(pack, schema)
