"""The registered queries over whole small tables: against SQL where there is some, else against a plain version."""

import os
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from strandline.llm import common, exact, mixing, packing, simhash, substrings
from strandline.llm.components import roots
from strandline.llm.queries import QUERIES
from tests.compare import TESTDATA, database, differences
from tests.llm import brute

SMALL, MIDDLE = (os.path.join(TESTDATA, sf) for sf in ("sf0.001", "sf0.01"))
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name].build(spark, SMALL), database(SMALL), QUERIES[name].sql) == []


def test_entry_lists_operators_and_pipeline():
    numbers = sorted(int(m[1]) for n in entry_point.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run


def test_main_text(spark):
    found = {r["page_id"]: r for r in QUERIES["op1_page_differences"].build(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        body = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL)[1]
        text = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", body))).split())
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"]) == (text, len(text))


def test_packing_round_trip(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {k: plain.encode(t or "", add_special_tokens=False).ids + [1] for k, t in docs.items()}
    found = QUERIES["op2_least_slack_packing"].build(spark, SMALL).collect()
    covered, filled = Counter(), {}
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        covered.update((r["doc_id"], r["start"] + n) for n in range(r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))
    for places in filled.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(filled) <= len(covered) / 2048 * 1.01 + 1
    with_ids = packing.packed(spark.read.parquet(f"{SMALL}/documents.parquet"), TOKENIZER, with_ids=True).collect()
    for r in with_ids:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


@pytest.mark.parametrize("full, part", [(256, 1024), (1, 1024), (10**9, 8)])
def test_near_copies(spark, monkeypatch, full, part):
    """With few and many masks, and with buckets dealt into parts."""
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "PART", part)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    first = brute.components(prints)
    expected = {r["doc_id"]: (format(p, "016x"), rows[f]["doc_id"]) for r, p, f in zip(rows, prints, first)}
    found = QUERIES["op5_simhash_components"].build(spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected
    assert len(set(first)) < len(rows)


def test_roots_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = spark.createDataFrame([*path, *star, (5, 5), (7, 6)], "a long, b long")
    found = {r["node"]: r["root"] for r in roots(links).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1300)}


@pytest.mark.parametrize("known, hot", [(True, False), (False, True), (True, True), (False, False)])
def test_repeats_when_windows_and_minimisers_are_common(spark, monkeypatch, known, hot):
    """Every third repeated window known, or none; every second cell of minimisers cut again, or none; results are the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    texts = [r["text"] or "" for r in rows]
    data, firsts = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])[:-1]
    words = substrings.Words(data, firsts)
    first, many, least = substrings.super_kmers(words)
    counts = Counter(d for f, m in zip(first, many) for d in substrings._digests(words, int(f), int(m)))
    twice = sorted(d for d, n in counts.items() if n > 1)
    assert len(twice) > 300
    cells = np.full(2**substrings.CELL_BITS // 8, 0x55 if hot else 0, np.uint8)
    plan = substrings.Common(np.unique(least) if known else least[:0], frozenset(twice[::3] if known else ()), cells)
    monkeypatch.setattr(substrings, "_common", lambda given, count: plan)
    monkeypatch.setattr(substrings, "SENT_BYTES", 100_000)
    split, gone = brute.without_repeats(texts)
    expected = {r["doc_id"]: " ".join(w for w, g in zip(ws, gs) if not g) for r, ws, gs in zip(rows, split, gone)}
    found = substrings.without_repeats(docs, with_text=True).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == expected
    assert sum(r["n_removed"] for r in found) == sum(map(sum, gone)) > 0


def shared_passage(docs, share):
    """Documents of unlike words, one in ``share`` of which holds the same passage, and all of which hold one phrase."""
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(docs):
        body = [f"d{i}x{k}" for k in range(60)]
        yield i, " ".join([*body[:20], "the phrase that all of them have", *body[20:], *([passage] if i % share == 0 else [])])


def test_common_windows_are_known_from_a_sample(spark):
    given = spark.createDataFrame(list(shared_passage(400, 20)), "r1 long, body string")
    common = substrings._common(given, 400)
    assert len(common.windows) == 26 and 0 < len(common.minimisers) < 60
    assert substrings._common(given.limit(0), 0).windows == frozenset()


def test_no_bucket_is_large(spark, monkeypatch):
    """A passage in one document of a thousand, and a phrase in all: no bucket gets more than four times what it should hold."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 100_000)
    monkeypatch.setattr(substrings, "HOT_BYTES", 25_000)
    monkeypatch.setattr(substrings, "SAMPLE_DOCS", 4000)
    rows = [(i, i, t) for i, t in shared_passage(20_000, 1000)]
    given = spark.createDataFrame(rows, "r1 long, r2 long, body string").repartition(8)
    common = substrings._common(given, len(rows))
    assert common.cells.any()
    buckets = 3 * sum(len(t) for _, _, t in rows) // 100_000
    sent = given.mapInArrow(substrings._sent(buckets, common), "bucket long, kind byte, blob binary")
    sizes = Counter()
    for r in sent.where("kind = 0").toLocalIterator():
        sizes[r["bucket"]] += sum(map(len, substrings._unpacked([r["blob"]])["text"].to_pylist()))
    assert max(sizes.values()) < 400_000
    found = substrings.repeated_spans(given).groupBy("r1").count().collect()
    assert {r["r1"] for r in found} == set(range(0, 20_000, 1000))


def test_filter_of_repeats_misses_none(spark, monkeypatch):
    """A filter far too small marks more rows, never fewer."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(map(tuple, exact.copies(docs).collect()))
    monkeypatch.setattr(exact, "MOST_CELLS", 64)
    monkeypatch.setattr(exact, "LEAST_CELLS", 64)
    assert sorted(map(tuple, exact.copies(docs).collect())) == whole
    assert sum(r[3] for r in whole) < len(whole)


def test_orders_cut_into_many_pieces(spark, monkeypatch):
    con = database(SMALL)
    monkeypatch.setattr(common, "ROWS_PER_PIECE", 3)
    for name in ("op3_stratified_shards", "op4_fair_mix"):
        assert differences(QUERIES[name].build(spark, SMALL), con, QUERIES[name].sql) == []


def test_shards_have_the_mixture(spark):
    shard = QUERIES["op3_stratified_shards"].build(spark, MIDDLE)
    source = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "source")
    counts = shard.join(source, "doc_id").groupBy("source").pivot("shard").count().na.fill(0).collect()
    for row in counts:
        assert max(row[1:]) - min(row[1:]) <= 2


def test_mix_comes_near_its_targets(spark):
    mix = QUERIES["op4_fair_mix"].build(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = mix.groupBy("source").agg(F.sum("taken"), F.first("target"), F.max("size")).collect()
    for _, taken, target, longest in rows:
        assert abs(taken - target) <= 2 * longest


def test_targets_fill_up(spark):
    given = spark.createDataFrame([(False, "a", 10, 1.0), (False, "b", 1000, 2.0), (False, "c", 1, 3.0), (True, "", 0, 1.0)], "none boolean, source string, total long, weight double")
    found = {r["source"]: r["target"] for r in mixing.fill_targets(given).collect()}
    assert found == {"a": 30.0, "b": 978.0, "c": 3.0, "": 0.0}


@pytest.mark.parametrize("name, label, least", [("op8_subword_toxicity", "toxic", 0.8), ("op10_attention_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", label)
    rows = QUERIES[name].build(spark, MIDDLE).where("held_out").join(labels, "doc_id").collect()
    ones, zeros = ([r["score"] for r in rows if r[label] == y] for y in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert better >= least


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    from strandline.llm import toxicity
    from strandline.llm.folds import held_out

    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert np.allclose(one.gram_scores(), two.gram_scores(), atol=1e-3)


def test_pipeline(spark):
    """Each stage's rows against a plain version of what it must keep, and the pieces against the tokenizer."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        given, before = kept, [r.asDict() for r in kept.collect()]
        kept = stage(spark, given, SMALL)
        if name != "packing":
            kept = common.stash(kept, "test-stage")
            assert kept.columns == docs.columns
            after = [r.asDict() for r in kept.collect()]
            counts.append(len(after))
        if name == "exact copies":
            best = {}
            for r in before:
                key = r["text"].translate(brute.LOWER)
                best[key] = max(best.get(key, r), r, key=lambda x: x["doc_id"])
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in best.values()}
        if name == "near copies":
            before.sort(key=lambda r: r["doc_id"])
            first = brute.similar([r["text"] for r in before])
            assert {r["doc_id"] for r in after} == {before[f]["doc_id"] for f in first}
        if name == "source mix":
            times = Counter(r["doc_id"] for r in after)
            plan = {r["doc_id"]: r["times"] for r in mixing.fair_queue(given, common.word_count("text")).collect()}
            assert times == Counter({k: n for k, n in plan.items() if n})
    assert counts[0] > counts[1] > counts[2] > counts[3]
    plain = Tokenizer.from_file(TOKENIZER)
    expected = sum(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in after)
    assert kept.agg(F.sum("length")).first()[0] == expected
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] == expected
