"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, clashing names and no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import exact, mixing, packing, pages, quality, sharding, simhash, substrings, topk, toxicity
from strandline.llm.common import word_count
from tests.llm import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(120_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "Same text here", "a"),
    (2, "same TEXT here", "b"),
    (2, "same TEXT here", "b"),
    (3, None, None),
    (4, "", "a"),
    (5, " \t\n", None),
    (None, "no id", "b"),
    (None, None, None),
    (6, LONG, "a"),
    (7, "start " + PASSAGE + " end", "b"),
    (8, "other words " + PASSAGE, "c"),
    (9, "Ünïcode É \U0001f600 words", "b"),
    (10, "x" * 300_000, "a"),
    (11, "Same text here", None),
    (11, "different under one id", "c"),
]
CLASHES = ("key size shard slot rank score print hash row rows piece order kept name start length n times target weight times "
           "place whole norm sha repeats bits body lines spans r1 r2 label group kind blob hash_ nth").split()  # fmt: skip


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], "doc_id long, text string, source string, n_chars long")
    extra = {c: F.lit(n) for n, c in enumerate(dict.fromkeys(CLASHES))}
    return plain.withColumns(extra).withColumn("map", F.create_map(F.lit("a"), F.lit(1))).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, 7) for i in range(1, 12)] + [(None, 1, 1, 7), (3, None, None, 7), (1, 1, 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score int")


def by_text(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_shards(docs):
    found = sharding.interleave(docs, 4, keep=("size",)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    counts = [sum(r["shard"] == s for r in found) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    assert sharding.interleave(docs.limit(0), 4).collect() == []


def test_mix(docs):
    found = mixing.fair_queue(docs, word_count("text")).collect()
    assert len(found) == len(ROWS)
    assert sum(r["size"] for r in found) == sum(len(brute.words(r[1])) for r in ROWS)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
    assert sum(r["taken"] for r in found) <= sum(r["size"] for r in found)
    again = mixing.fair_queue(docs, word_count("text")).collect()
    assert by_text(found, "doc_id", "size", "taken") == by_text(again, "doc_id", "size", "taken")
    assert mixing.fair_queue(docs.limit(0), word_count("text")).collect() == []
    wordless = mixing.fair_queue(docs.where("text IS NULL"), word_count("text")).collect()
    assert {(r["target"], r["taken"]) for r in wordless} == {(0.0, 0)}


def test_copies(docs):
    found = exact.copies(docs).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for key, text, _ in ROWS:
        groups.setdefault((text or "").translate(brute.LOWER), []).append(key)
    sizes = sorted(r["group_size"] for r in found)
    assert sizes == sorted(len(g) for g in groups.values() for _ in g)
    assert sum(r["kept"] for r in found) == len(groups)
    assert {r["keep_id"] for r in found if r["group_size"] == 4} == {11}
    assert {r["keep_id"] for r in found if r["group_size"] == 3} == {4}
    assert exact.copies(docs.limit(0)).collect() == []


def test_packing(docs):
    found = packing.packed(docs, TOKENIZER).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in pieces.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    empty = [r for r in found if r["doc_id"] in (3, 4, 5)]
    assert all(r["length"] == r["doc_tokens"] == 1 for r in empty) and len(empty) == 3
    assert sum(r["start"] == 0 for r in found) == len(ROWS)
    assert packing.packed(docs.limit(0), TOKENIZER).collect() == []


def test_near_copies(docs):
    found = simhash.near_copies(docs).collect()
    assert by_text(found, "doc_id", "fingerprint") == sorted(((k, format(brute.fingerprint(t), "016x")) for k, t, _ in ROWS), key=repr)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {3}
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_repeats(docs):
    found = substrings.without_repeats(docs, with_text=True).collect()
    texts = [r[1] for r in ROWS]
    split, gone = brute.without_repeats(texts)
    expected = [(r[0], len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for r, w, g in zip(ROWS, split, gone)]
    assert by_text(found, "doc_id", "n_words", "n_removed", "kept") == sorted(expected, key=repr)
    assert substrings.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(docs, labels, module, label):
    found = module.judged(docs, labels).collect()
    assert by_text(found, "doc_id", "held_out") == sorted(((r[0], brute.held_out(r[0])) for r in ROWS), key=repr)
    assert all(0 <= r["score"] <= 1 for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert module.judged(docs.limit(0), labels).collect() == []
    none = module.judged(docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [1.0, -1.0]), (7, [0.25, 0.0]), (3, [0.25, 0.0]), (9, None), (8, [nan, 1.0]), (100, [inf, 1.0]),
        (11, [0.1, None]), (12, [1.0]), (150, []), (13, []), (None, [1.0, 1.0]), (200, [1e30, 1e30, 1e-3]), (14, [1e30, -1e30, 1.0]),
    ]
    given = spark.createDataFrame([(i, v, 5, 6) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    found = topk.nearest(given, F.col("id") % 50 == 0).collect()
    zero = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert zero == [(1, 50, 32768), (2, 3, 8192), (3, 7, 8192), (4, 50, 0)]
    assert [(r["vec_id"], r["score"]) for r in found if r["query_id"] == 150] == [(13, 0)]
    assert [r["vec_id"] for r in found if r["query_id"] == 200] == [14]
    assert not [r for r in found if r["query_id"] == 100]
    assert topk.nearest(given.limit(0), F.col("id") % 50 == 0).collect() == []


def test_pages(spark):
    page = "<nav>m</nav><article><p>only  here</p></article>"
    rows = [(1, "http://h/a", page), (2, "http://h/b", page), (2, "http://h/b", page), (3, None, "<p>loose"), (None, "x", None), (5, "", "")]
    rows += [(n, f"http://s/{n}", f"<div>site</div><p>text {n}<div>bottom</div>") for n in range(10, 10 + 3 * pages.GROUP_PAGES)]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, lines int")
    found = pages.main_text(given).collect()
    assert len(found) == len(rows)
    assert all(r["text"] == f"text {r['page_id']}" for r in found if (r["page_id"] or 0) >= 10)
    assert [r["text"] for r in found if r["page_id"] in (1, 2)] == ["only here"] * 3
    assert [(r["text"], r["n_chars"]) for r in found if r["page_id"] == 3] == [("loose", 5)]
    assert [r["text"] for r in found if r["page_id"] in (None, 5)] == ["", ""]
    assert pages.main_text(given.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = stage(spark, docs, str(tmp_path))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.collect() == []
    if name == "packing":
        assert found.where("start = 0").count() == len(ROWS)
        return
    assert found.columns == docs.columns and empty.columns == docs.columns
    rows = found.select("doc_id", "text").collect()
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(k, t) for k, t, _ in ROWS}
    if name == "exact copies":
        assert len(rows) == len({(t or "").translate(brute.LOWER) for _, t, _ in ROWS})
    if name == "near copies":
        assert len(rows) == len(set(brute.similar([t for _, t, _ in ROWS])))
    if name == "source mix":
        assert sum(len(brute.words(r["text"])) for r in rows) == mixing.fair_queue(docs, word_count("text")).agg(F.sum("taken")).first()[0]
