"""The quality classifier learns from every passage, and its query equals a plain training and scoring."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality, toxicity
from tests.llm import brute


def prose(rng, words):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 20, rng.integers(2, 9))) for _ in range(words))


def test_a_passage_far_into_the_text_tells():
    """Sixty passages, of which the fortieth alone is unlike: no even choice of 32 has it."""
    rng = np.random.default_rng(4)
    texts = []
    for n in range(120):
        words = prose(rng, 60 * quality.PASSAGE_WORDS).split()
        if n % 2:
            words[39 * quality.PASSAGE_WORDS : 40 * quality.PASSAGE_WORDS] = ["#%&$"] * quality.PASSAGE_WORDS
        texts.append(" ".join(words).encode())
    bags = [quality.bag(t) for t in texts]
    assert min(map(len, bags)) >= 60
    model = quality.train(bags[:80], [n % 2 for n in range(80)], [1.0] * 80, rounds=40, rate=5e-3)
    found = quality.scores(pa.array([t.decode() for t in texts[80:]]), model)
    assert sum((s > 0.5) == n % 2 for n, s in enumerate(found)) >= 38


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    rows = [(n, prose(rng, int(rng.integers(3, 400))) + (" !!" * 9 if n % 3 else ""), int(n % 3 > 0)) for n in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in rows], "doc_id long, quality int, toxic int").repartition(3)
    return rows, docs, labels


def test_the_query_equals_plain_training(tables):
    rows, docs, labels = tables
    known = [r for r in rows if not brute.held_out(r[0])]
    order = sorted(known, key=lambda r: hashlib.md5(f"10:{r[0]}".encode()).hexdigest())
    share = sum(r[2] for r in known) / len(known)
    counts = {y: sum(r[2] == y for r in known) for y in (0, 1)}
    bags = [quality.bag(r[1].encode()).astype(np.float16) for r in order]
    model = quality.train(bags, [r[2] for r in order], [(share if r[2] else 1 - share) / counts[r[2]] for r in order])
    expected = {r[0]: plain_score(r[1], model) for r in rows}
    found = quality.judged(docs, labels).collect()
    assert {r["doc_id"] for r in found} == set(expected)
    for r in found:
        assert r["score"] == pytest.approx(expected[r["doc_id"]], abs=1e-3)
        assert (r["held_out"], r["predicted"]) == (brute.held_out(r["doc_id"]), int(r["score"] >= 0.3))


def plain_score(text, model):
    """Gated attention over a text's passages, one by one."""
    coded, raw = [], []
    for passage in quality.bag(text.encode()):
        code = np.tanh((passage - model.mean) / model.spread @ model.encode + model.encode_bias)
        gate = 1 / (1 + np.exp(-(code @ model.gate_sigmoid)))
        coded.append(code)
        raw.append(float((np.tanh(code @ model.gate_tanh) * gate) @ model.attend))
    power = [math.exp(x - max(raw)) for x in raw]
    pooled = sum(p * c for p, c in zip(power, coded)) / sum(power)
    return 1 / (1 + math.exp(-float(pooled @ model.head + model.bias[0])))


def test_toxicity_scores_equal_a_plain_mean(tables):
    """A score is the mean of the scores of a text's subwords, made a probability."""
    rows, docs, labels = tables
    model = toxicity.fit(docs, labels)
    grams, bias = model.gram_scores(), float(model.bias[1] - model.bias[0])
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for key, text, _ in rows:
        buckets, shares = toxicity.bag(text.encode())
        assert found[key] == pytest.approx(1 / (1 + math.exp(-(float(grams[buckets] @ shares) + bias))), abs=1e-4)


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, ys, weights: seen.append(len(bags)))
    docs = spark.range(400).select((F.col("id") % 4 + 1).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(1, 5)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)
    assert seen == [sum(not brute.held_out(n) for n in range(1, 5))]
