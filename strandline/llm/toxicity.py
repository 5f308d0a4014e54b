"""Toxicity: bags of subword embeddings, averaged into a linear softmax."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import stash
from strandline.llm.folds import held_out, sample, within
from strandline.llm.texts import CHUNK, raw, runs

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 16
SAMPLE_PER_CLASS = 4000
FRAGMENTS, FRAGMENT_SHARE = 2, 0.3  # of each sampled clean text, and their part of the clean texts' weight
SAMPLE_FEATURES = 24_000_000  # that the sample may have on the driver, at 8 bytes each; beyond, it has fewer documents

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[9:14] = 32


@dataclass
class SubwordModel:
    """``vectors`` (buckets x size) are averaged over a text's grams; ``heads`` (2 x size) and ``bias`` give the logits."""

    vectors: np.ndarray
    heads: np.ndarray
    bias: np.ndarray

    def gram_scores(self) -> np.ndarray:
        """What each bucket adds to the margin of class 1, as the mean and the heads are both linear."""
        return (self.vectors @ (self.heads[1] - self.heads[0])).astype(np.float32)


def _grams(plain: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length, the bucket of the gram at each of the first ``most`` places and whether it counts.

    A gram lies within one word and the space on either side of it, which marks where a word begins or ends.
    """
    letters = plain.astype(np.uint32)
    space = plain == 32
    value = letters[:-1] * np.uint32(0x01000193) ^ letters[1:]
    inner = np.ones(max(0, len(plain) - 1), bool)
    for n in range(3, GRAMS[-1] + 1):
        value = value[:-1] * np.uint32(0x01000193) ^ letters[n - 1 :]
        inner = inner[:-1] & ~space[n - 2 : len(plain) - 1]
        mixed = value * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed ^= mixed >> np.uint32(15)
        yield (mixed * np.uint32(0x85EBCA77) >> np.uint32(32 - BUCKETS.bit_length() + 1))[:most], inner[:most]


def _padded(data, starts, ends, first, last) -> tuple[np.ndarray, np.ndarray]:
    """The texts ``first`` to ``last``, a space before and after each, and where each of them starts."""
    places = starts[first:last] - starts[first] + 2 * np.arange(last - first)
    plain = np.full(int(ends[last - 1] - starts[first]) + 2 * (last - first), 32, np.uint8)
    for k, at in enumerate(places):
        a, b = starts[first + k], ends[first + k]
        plain[at + 1 : at + 1 + b - a] = data[a:b]
    return _PLAIN[plain], places


def _slices(plain: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in slices that overlap by a gram, and how many places of each count."""
    for at in range(0, len(plain), CHUNK):
        yield plain[at : at + CHUNK + GRAMS[-1] - 1], CHUNK


def margins(column: pa.Array, score: np.ndarray) -> np.ndarray:
    """The mean of ``score`` over the grams of each text; 0 for a text without any."""
    data, starts, ends = raw(column)
    out = np.zeros(len(starts))
    for first, last in runs(starts, ends):
        plain, places = _padded(data, starts, ends, first, last)
        total, count = np.zeros(last - first), np.zeros(last - first)
        if last - first == 1:
            for part, most in _slices(plain):
                for bucket, counts in _grams(part, most):
                    total[0] += score[bucket][counts].sum(dtype=np.float64)
                    count[0] += np.count_nonzero(counts)
        else:
            for bucket, counts in _grams(plain, len(plain)):
                size = len(bucket)
                at, to = places.clip(0, size), np.append(places[1:], size).clip(0, size)
                sums = np.concatenate([[0.0], np.cumsum(np.where(counts, score[bucket], 0), dtype=np.float64)])
                hits = np.concatenate([[0], np.cumsum(counts)])
                total += sums[to] - sums[at]
                count += hits[to] - hits[at]
        out[first:last] = total / np.maximum(count, 1)
    return out


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's grams and the share of the grams in each."""
    plain = _PLAIN[np.frombuffer(b" " + text + b" ", np.uint8)]
    counts = np.zeros(BUCKETS)
    for part, most in _slices(plain):
        for bucket, inside in _grams(part, most):
            counts += np.bincount(bucket[inside], minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.uint16), (counts[found] / max(1.0, counts.sum())).astype(np.float32)


def fragments(text: bytes, count: int = FRAGMENTS) -> list[bytes]:
    """Short runs of words from a text, where a hash of the text says. A text without words has none."""
    words, rng = text.split(), np.random.default_rng(zlib.crc32(text))
    found = []
    for _ in range(count if words else 0):
        size = int(rng.integers(3, 16))
        at = int(rng.integers(0, max(1, len(words) - size)))
        found.append(b" ".join(words[at : at + size]))
    return found


def train(bags, labels, weights, size: int = 16, rounds: int = 10, batch: int = 256, rate: float = 0.1, decay: float = 0.02, seed: int = 8) -> SubwordModel:
    """Fit vectors and heads together by Adam on the weighted cross-entropy.

    The loss reaches the vectors only through ``vectors @ heads.T``, so a step needs the documents'
    bags times that product and its gradient, never a vector per gram of a document.
    """
    rng = np.random.default_rng(seed)
    # Vectors start near zero, so that grams never seen in training stay without a say.
    small = np.float32(1e-3)
    model = SubwordModel(rng.standard_normal((BUCKETS, size), np.float32) * small, rng.standard_normal((2, size), np.float32) / 2, np.zeros(2, np.float32))
    parts = [model.vectors, model.heads, model.bias]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    labels, weights = np.asarray(labels), np.asarray(weights)
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            bucket = np.concatenate([bags[i][0] for i in chosen]).astype(np.int64)
            share = np.concatenate([bags[i][1] for i in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            product = model.vectors @ model.heads.T
            logits = model.bias + np.stack([np.bincount(doc, share * product[bucket, c], len(chosen)) for c in (0, 1)], 1)
            logits -= logits.max(1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error *= (weights[chosen] / weights[chosen].sum())[:, None]
            back = np.stack([np.bincount(bucket, share * error[doc, c], BUCKETS) for c in (0, 1)], 1)
            slopes = [back @ model.heads, back.T @ model.vectors, error.sum(0)]
            step += 1
            for p, g, m, v in zip(parts, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * p)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> SubwordModel:
    """Fit on at most ``per_class`` labelled documents a class, held-out rows excluded.

    Executors turn the sampled texts into bags and count their entries. Where those are more than ``SAMPLE_FEATURES``, each class
    gives fewer documents, those first by their hash; where they lie in the table has no say. The driver
    weighs the classes as all labelled rows have them. What is cut from a clean text is clean, so
    short fragments of those are learned from too; else short texts would be judged by words hardly seen. Without a labelled row of both
    classes the score is the share of class 1, or a half where there are no labels at all.
    """
    rows, shares = sample(docs, labels, label, per_class, 8, key, text)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for y, text, order in zip(*(part.column(c).to_pylist() for c in ("y", "body", "order"))):
                body = (text or "").encode()
                own = [(False, *bag(body))] + [(True, *bag(f)) for f in (fragments(body) if y == 0 else ())]
                found += [(y, order, sum(len(b) for _, b, _ in own), *one) for one in own]
            ys, orders, sizes, cut, buckets, shares_ = zip(*found) if found else ((),) * 6
            columns = [pa.array(ys, pa.int32()), pa.array(orders, pa.string()), pa.array(sizes, pa.int64()), pa.array(cut, pa.bool_())]
            columns += [pa.array([a.tobytes() for a in of], pa.binary()) for of in (buckets, shares_)]
            yield pa.RecordBatch.from_arrays(columns, ["y", "order", "size", "cut", "buckets", "shares"])

    every = stash(rows.mapInArrow(bags, "y int, order string, size long, cut boolean, buckets binary, shares binary"), "bags")
    last = within([tuple(r) for r in every.where("NOT cut").select("order", "y", "size").collect()], SAMPLE_FEATURES)
    chosen = every.where(F.lit(False))
    for y, order in last.items():
        chosen = chosen.unionAll(every.where((F.col("y") == y) & (F.col("order") <= order)))
    got, ys, kinds = [], [], []
    for row in chosen.toLocalIterator():
        got.append((np.frombuffer(row["buckets"], np.uint16), np.frombuffer(row["shares"], np.float32)))
        ys.append(row["y"])
        kinds.append((row["y"], row["cut"]))
    if len(set(ys)) < 2:
        share = shares[1] if ys else 0.5
        bias = np.log(np.clip([1 - share, share], 1e-6, 1))
        return SubwordModel(np.zeros((BUCKETS, 1)), np.zeros((2, 1)), bias)
    counts = Counter(kinds)
    part = {(1, False): 1.0, (0, False): 1 - FRAGMENT_SHARE * ((0, True) in counts), (0, True): FRAGMENT_SHARE}
    return train(got, ys, [shares[y] * part[y, cut] / counts[y, cut] for y, cut in kinds])


def score(docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: more likely toxic) of every row, from its whole text.

    Only the text is an input. A null or empty text gets the score of the bias alone. Rows stay where
    they are; repeated rows get equal scores; a very long text is taken in bounded slices; an empty table gives an empty result; other columns are
    not read.
    """
    grams, bias = model.gram_scores(), float(model.bias[1] - model.bias[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            margin = margins(part.column("body"), grams) + bias
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(1 / (1 + np.exp(-margin.clip(-500, 500))))], [key, "score"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(scored, f"`{key}` {kind}, score double")


def clean(docs: DataFrame, model: SubwordModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``.

    Texts are judged whole, in bounded slices; a null text like an empty one. Rows stay where they are, repeated rows stay or go together, columns
    may have any names, and an empty table gives an empty result.
    """
    grams, bias = model.gram_scores(), float(model.bias[1] - model.bias[0])
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            margin = margins(part.column(place), grams) + bias
            yield part.filter(pa.array(1 / (1 + np.exp(-margin.clip(-500, 500))) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit and score: ``key``, ``held_out``, ``score`` and ``predicted`` of every document."""
    found = score(docs, fit(docs, labels, key=key, text=text), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
