"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import stash
from strandline.llm.folds import held_out, sample, within
from strandline.llm.texts import raw, runs

PASSAGE_WORDS = 48
PASSAGE_BYTES = 1024  # a passage also ends with the word that passes a multiple of this; a longer word is cut into several
PAIRS = 256
SAMPLE_PER_CLASS = 2000
SAMPLE_PASSAGES = 150_000  # of all training documents; where there are more, each class gives fewer documents
SLICE = 1 << 20  # bytes of a long text that are encoded at once
FEATURES = 256 + PAIRS + 6

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Before:
    """What comes before a slice of a text that begins where a passage does, and how long the whole text is."""

    bytes: int = 0
    words: int = 0
    length: int = 0


def passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of some texts (passages x FEATURES) and the text each belongs to.

    ``data`` holds the texts one after another. A passage is a run of words of one text; the encoding has
    its bytes and hashed byte pairs as shares, and how long, how varied and how repetitive its words are.
    A text without words has one passage of zeros.
    """
    return _encoded(data, starts, ends)[:2]


def slices(data: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """The encodings of a long text's passages, some at a time: the same as all at once."""
    before, at = Before(0, 0, end - start), start
    while True:
        size = SLICE
        while True:
            to = min(end, at + size)
            found, _, opens, words = _encoded(data, np.array([at]), np.array([to]), before)
            if to == end or len(opens) > 1:
                break
            size *= 2
        if to == end:
            yield found
            return
        # The last passage may go on; the next slice begins with it.
        yield found[:-1]
        before = Before(before.bytes + int(opens[-1]), before.words + int(words[-1]), before.length)
        at += int(opens[-1])


def _encoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: Before | None = None) -> tuple[np.ndarray, ...]:
    """``passages``, and where each begins, in bytes and in words; ``before`` if there is one text and it is a slice."""
    lengths = (ends - starts).astype(np.int64)
    base = int(starts[0]) if len(starts) else 0
    text = data[base : base + int(lengths.sum())]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    space = _SPACE[text]
    edge = np.ones(len(text), bool)
    edge[1:] = doc[1:] != doc[:-1]
    begins = ~space
    begins[1:] &= space[:-1] | edge[1:]
    every = np.arange(len(text))
    begins |= ~space & ((every - np.maximum.accumulate(np.where(begins, every, 0))) % PASSAGE_BYTES == 0) if len(text) else begins
    word_at = np.flatnonzero(begins)
    if not len(word_at):
        return np.zeros((len(lengths), FEATURES), np.float32), np.arange(len(lengths)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_doc = doc[word_at]
    first_word = np.searchsorted(word_doc, np.arange(len(lengths)))
    nth = np.arange(len(word_at)) - first_word[word_doc] + (before.words if before else 0)
    block = (word_at - firsts[word_doc] + (before.bytes if before else 0)) // PASSAGE_BYTES
    opens = (nth % PASSAGE_WORDS == 0) | np.concatenate([[True], (block[1:] != block[:-1]) | (word_doc[1:] != word_doc[:-1])])
    passage_of_word = np.cumsum(opens) - 1
    count = int(passage_of_word[-1]) + 1
    owner = word_doc[opens]

    # Every byte that is not white space belongs to the passage of its word.
    word_of_byte = np.cumsum(begins) - 1
    solid = np.flatnonzero(~space)
    passage = passage_of_word[word_of_byte[solid]]
    letter = text[solid].astype(np.int64)
    size = np.bincount(passage, minlength=count).astype(np.float32)
    single = np.bincount(passage * 256 + letter, minlength=count * 256).reshape(count, 256)
    follows = np.append(np.where(edge[1:], 32, text[1:]), data[base + len(text)] if before and base + len(text) < base + before.length - before.bytes else 32)[solid].astype(np.int64)
    pair = ((letter * 257 + follows) * 40503 >> 6) % PAIRS
    double = np.bincount(passage * PAIRS + pair, minlength=count * PAIRS).reshape(count, PAIRS)

    # A hash a word: the sum of its bytes, each weighed by its place.
    place = solid - word_at[word_of_byte[solid]]
    weight = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    mixed = (text[solid].astype(np.uint64) + np.uint64(1)) * weight
    mixed ^= mixed >> np.uint64(29)
    edge = np.searchsorted(solid, word_at)
    hashes = np.add.reduceat(mixed, edge)
    words = np.bincount(passage_of_word, minlength=count).astype(np.float32)
    order = np.lexsort((hashes, passage_of_word))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage_of_word[order][1:] != passage_of_word[order][:-1])
    distinct = np.bincount(passage_of_word[order][fresh], minlength=count)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])
    lines = np.bincount(passage_of_word[word_of_byte[np.flatnonzero((text == 10) & (word_of_byte >= 0))]], minlength=count)

    extra = np.stack(
        [
            np.log1p(words) / 4,
            np.log1p(size / words) / 3,
            distinct / words,
            np.bincount(passage_of_word, again, count) / words,
            lines / words,
            np.log1p(np.full(len(owner), before.length) if before else lengths[owner]) / 10,
        ],
        1,
    )
    found = np.concatenate([np.sqrt(single / size[:, None]), np.sqrt(double / size[:, None]), extra], 1).astype(np.float32)
    bare = np.setdiff1d(np.arange(len(lengths)), owner)
    if len(bare):
        found = np.concatenate([found, np.zeros((len(bare), FEATURES), np.float32)])
        owner = np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner, word_at[opens], np.flatnonzero(opens)


@dataclass
class AttentionModel:
    """Passages are encoded, weighed by gated attention within their document, and the sum is judged."""

    mean: np.ndarray
    spread: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    gate_tanh: np.ndarray
    gate_sigmoid: np.ndarray
    attend: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.gate_tanh, self.gate_sigmoid, self.attend, self.head, self.bias]

    def hidden(self, found: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scaled passages, their encodings, both gates and the attention before it is normalised."""
        scaled = (found - self.mean) / self.spread
        coded = np.tanh(scaled @ self.encode + self.encode_bias)
        tanh, sigmoid = np.tanh(coded @ self.gate_tanh), 1 / (1 + np.exp(-(coded @ self.gate_sigmoid)))
        return scaled, coded, tanh, sigmoid, (tanh * sigmoid) @ self.attend


def _spread(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The mean and, nearly, the standard deviation of each feature of all passages."""
    count = sum(map(len, bags))
    mean = sum(b.sum(0, np.float64) for b in bags) / count
    square = sum((b.astype(np.float64) ** 2).sum(0) for b in bags) / count
    return mean.astype(np.float32), (np.sqrt((square - mean**2).clip(0)) + 0.02).astype(np.float32)


def train(bags: list[np.ndarray], labels, weights, size: int = 24, gate: int = 12, rounds: int = 24, batch: int = 64, rate: float = 2e-3, decay: float = 1e-2, seed: int = 10) -> AttentionModel:
    """Fit all parts together by Adam on the weighted cross-entropy of the documents."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    model = AttentionModel(
        *_spread(bags), draw(FEATURES, size), zero(size), draw(size, gate), draw(size, gate), draw(gate, 1)[:, 0], draw(size, 1)[:, 0], zero(1)
    )
    first, second, step = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], 0
    labels, weights = np.asarray(labels, np.float32), np.asarray(weights, np.float32)
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            found = np.concatenate([bags[i] for i in chosen]).astype(np.float32)
            lengths = np.array([len(bags[i]) for i in chosen])
            starts, doc = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(chosen)), lengths)
            scaled, coded, tanh, sigmoid, raw_ = model.hidden(found)
            power = np.exp(raw_ - np.maximum.reduceat(raw_, starts)[doc])
            share = power / np.add.reduceat(power, starts)[doc]
            pooled = np.add.reduceat(share[:, None] * coded, starts)
            error = 1 / (1 + np.exp(-(pooled @ model.head + model.bias[0]))) - labels[chosen]
            error *= weights[chosen] / weights[chosen].sum()
            to_pooled = error[:, None] * model.head
            to_share = (to_pooled[doc] * coded).sum(1)
            to_raw = share * (to_share - np.add.reduceat(share * to_share, starts)[doc])
            to_gate = to_raw[:, None] * model.attend
            to_tanh, to_sigmoid = to_gate * sigmoid * (1 - tanh**2), to_gate * tanh * sigmoid * (1 - sigmoid)
            to_coded = to_pooled[doc] * share[:, None] + to_tanh @ model.gate_tanh.T + to_sigmoid @ model.gate_sigmoid.T
            to_inner = to_coded * (1 - coded**2)
            slopes = [scaled.T @ to_inner, to_inner.sum(0), coded.T @ to_tanh, coded.T @ to_sigmoid, (tanh * sigmoid).T @ to_raw, pooled.T @ error, np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(model.parts(), slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * p)).astype(np.float32)
    return model


def scores(column: pa.Array, model: AttentionModel) -> np.ndarray:
    """The score of each text of a column from all its passages.

    Texts are taken in runs of bounded size. A longer text is taken in slices; attention is carried on
    over them as a running maximum, sum and weighted sum.
    """
    data, starts, ends = raw(column)
    out = np.zeros(len(starts))

    def pooled(encoded: Iterator[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
        top, total, code = np.full(count, -np.inf), np.zeros(count), np.zeros((count, len(model.head)))
        for found, owner in encoded:
            *_, coded, _, _, raw_ = model.hidden(found)
            opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            who = owner[opens]
            high = np.maximum(top[who], np.maximum.reduceat(raw_, opens))
            fade = np.exp(top[who] - high)
            power = np.exp(raw_ - np.repeat(high, np.diff(np.append(opens, len(owner)))))
            total[who] = total[who] * fade + np.add.reduceat(power, opens)
            code[who] = code[who] * fade[:, None] + np.add.reduceat(power[:, None] * coded, opens)
            top[who] = high
        return code / total[:, None]

    for first, last in runs(starts, ends):
        a, b = starts[first:last], ends[first:last]
        whole = last - first > 1 or b[0] - a[0] <= SLICE
        encoded = iter([passages(data, a, b)]) if whole else ((f, np.zeros(len(f), np.int64)) for f in slices(data, int(a[0]), int(b[0])))
        out[first:last] = pooled(encoded, last - first) @ model.head + model.bias[0]
    # Products of single-precision matrices differ in the last digits with their shape; rounding hides that.
    return np.round(1 / (1 + np.exp(-out.clip(-500, 500))), 6)


def bag(text: bytes) -> np.ndarray:
    """All passages of a training text."""
    return passages(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel:
    """Fit on at most ``per_class`` labelled documents a class, held-out rows excluded.

    Every passage of a sampled document is learned from. Where the sample has more than ``SAMPLE_PASSAGES``, each class gives fewer
    documents, those first by their hash. The classes weigh as all labelled rows have them. Without a labelled row of both classes the
    score is the share of class 1, or a half where there are no labels at all.
    """
    rows, shares = sample(docs, labels, label, per_class, 10, key, text)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for n, body in enumerate(part.column("body").to_pylist()):  # one by one: a text may have very many passages
                found = bag(body.encode())
                columns = [part.column(c).slice(n, 1) for c in ("y", "order")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(found)]), pa.array([found.astype(np.float16).tobytes()], pa.binary())], names)

    names = ["y", "order", "size", "passages"]
    every = stash(rows.mapInArrow(bags, "y int, order string, size long, passages binary"), "bags")
    last = within([tuple(r) for r in every.select("order", "y", "size").collect()], SAMPLE_PASSAGES)
    chosen = every.where(F.lit(False))
    for y, order in last.items():
        chosen = chosen.unionAll(every.where((F.col("y") == y) & (F.col("order") <= order)))
    read = sorted(((r["order"], r["y"], r["passages"]) for r in chosen.toLocalIterator()), key=lambda r: r[0])
    got, ys = [np.frombuffer(p, np.float16).reshape(-1, FEATURES) for _, _, p in read], [y for _, y, _ in read]
    if len(set(ys)) < 2:
        share = shares[1] if ys else 0.5
        flat = lambda *n: np.zeros(n, np.float32)
        bias = np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))])
        return AttentionModel(flat(FEATURES), flat(FEATURES) + 1, flat(FEATURES, 1), flat(1), flat(1, 1), flat(1, 1), flat(1), flat(1), bias)
    return train(got, ys, [shares[y] / ys.count(y) for y in ys])


def score(docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: better) of every row, from its whole text.

    Only the text is an input. A null or empty text is one passage of zeros. A very long text is taken in slices, with the result of the
    whole. Rows stay where they are; repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(scores(part.column("body"), model))], [key, "score"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    return narrow.mapInArrow(scored, f"`{key}` {narrow.schema['key'].dataType.simpleString()}, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit and score: ``key``, ``held_out``, ``score`` and ``predicted`` of every document."""
    found = score(docs, fit(docs, labels, key=key, text=text), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
