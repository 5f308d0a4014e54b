"""Spelling variants against all pairs of words."""

import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import spellings
from tests.llm import brute

LETTERS = "abcdeéÿÀ"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_variants(words):
    """The rows of ``variants`` by comparing every two words."""
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, root, form[w], words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(rows)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    found = {}
    while len(found) < 700:
        word = "".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 9)))
        found[word] = rng.choice([3, 4, 9, 40, 1000])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice(LETTERS) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(LETTERS) + word[i + 1 :]])
            if len(word) >= 5:
                found[word] = rng.choice([3, 5, 80])
    found |= {"z" * 70: 5, "z" * 71: 12, "z" * 69 + "a": 3, "y" * 300_000: 4, "y" * 299_999: 9, "zzzzz": 3, "zzzzzz": 6, "zzzzzzz": 12, "zzzzzzzz": 24}
    return found


@pytest.mark.parametrize("bucket, leaf, verified", [(5000, 512, 100_000), (20, 1, 50), (1, 4, 1000)])
def test_variants(spark, monkeypatch, words, bucket, leaf, verified):
    """With one level above the buckets, several, and words that the whole trie leaves together."""
    monkeypatch.setattr(spellings, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(spellings, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(spellings, "VERIFIED", verified)
    given = words if bucket > 1 else {w: n for w, n in words.items() if len(w) < 1000}  # meeting by deletions is for many words of few letters
    table = spark.createDataFrame(list(given.items()), "word string, n long").selectExpr("*", "1 AS near", "2 AS form").repartition(4)
    found = spellings.variants(table).select("word", "root", "form", "n", "n_near", "form_n")
    assert sorted(map(tuple, found.collect())) == all_variants(given)


def test_a_form_leads_to_the_last(spark):
    words = {"z" * n: 3 * 2 ** (n - 5) for n in range(5, 45)}
    found = {r["word"]: r["root"] for r in spellings.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"z" * 44} and len(found) == 40


def test_pruning_meets_few_pairs(words):
    short = [w for w in words if len(w) < 50]
    counts = spellings.group_counts(short, 12)
    assert (counts[:, 1:].sum(1) == counts[:, 0]).all() and counts[:, 0].tolist() == [len(w) for w in short]
    met = sum(len(a) for a, _ in spellings.Trie(counts).meet(counts))
    assert met < len(short) ** 2 / 4


def test_occurrences(spark):
    rows = [(1, "Straße straße STRASSE x÷y×z étéé ÉTÉÉs"), (1, "Straße straße STRASSE x÷y×z étéé ÉTÉÉs"), (2, None), (None, "straße straß strasse-abcde_abcde1abcde"), (3, ""), (4, "q" * 200_000)]
    given = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, word int, n int").repartition(3)
    total = Counter()
    for _, text in rows:
        total.update(spellings.RUN.findall((text or "").translate(brute.LOWER)))
    expected = {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}
    assert dict(map(tuple, spellings.occurrences(given).collect())) == expected and len(expected) == 3
    doubled = {w + w: n for w, n in total.items() if n >= 3 and len(w) >= 3}
    assert dict(map(tuple, spellings.occurrences(given, change=lambda key, run: run + run if len(run) > 2 else run).collect())) == doubled
    assert spellings.occurrences(given.limit(0)).collect() == []
    assert spellings.variants(spellings.occurrences(given.limit(0))).collect() == []


def test_letters_of_every_pair(words):
    some = [w for w in words if len(w) > 60 or len(w) < 6] + ["", "a", "ab", "b", "abc", "acb", "Àb"]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(len(some))))
    found = spellings.Letters(some).apart_by_one(left, right)
    for a, b, near in zip(left, right, found):
        if len(some[a]) < 1000 or len(some[b]) < 1000:
            assert near == one_apart(some[a], some[b])
