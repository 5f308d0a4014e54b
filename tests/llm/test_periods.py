"""Periodic runs against a search of every period."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strandline.llm import periods
from tests.llm import brute


def every_run(words, least=12):
    """Start, length and smallest period of each run, by trying all periods."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words):
    gone = {i for s, n, q in every_run(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4), st.sampled_from([2, 12]))
def test_runs_of_few_letters(texts, least):
    patched, periods.LEAST_LENGTH = periods.LEAST_LENGTH, least
    try:
        found = periods.found_runs(periods.numbered(texts)).tolist()
    finally:
        periods.LEAST_LENGTH = patched
    at, expected = 0, []
    for words in texts:
        expected += [[s + at, n, q] for s, n, q in every_run(words, least)]
        at += len(words)
    assert found == expected


def test_runs_within_runs():
    """Squares of words that are nearly periodic themselves, where a factor's next occurrence is not a period away."""
    for root in ("abababa", "aabaabaaab", "abaababaabaab", "aaaaaaab"):
        for before in ("", "a", "b", "ab", "x"):
            words = [c.encode() for c in before + root * 2 + "ab" + root * 3]
            assert periods.found_runs(periods.numbered([words])).tolist() == [list(r) for r in every_run(words)]


def test_one_word_a_million_times():
    assert periods.found_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    stretch = [f"s{i}" for i in range(500)]
    return [
        (1, "ha " * 40), (1, "ha " * 40), (2, None), (3, ""), (4, " \t\n"), (None, "x y " * 7 + "z"), (None, None),
        (5, " ".join(stretch * 30 + [f"e{i}" for i in range(50)])), (6, " ".join(rng.choice("ab") for _ in range(3000))), (7, "É é e " * 9), (8, "z" * 300_000),
        (9, "\r\n".join(["One", "one"] * 6)), (10, "a b c d e f " * 2), (11, "a b c d e " * 2),
    ]


def test_every_text(spark, rows):
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, body int").repartition(3)
    found = periods.periodic_runs(given, with_text=True).collect()
    expected = []
    for key, text in rows:
        words = brute.words(text)
        left = collapsed(words)
        expected.append((key, len(words), every_run(words), left, hashlib.sha256(left.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["collapsed_sha256"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(len(r[2]) for r in expected) > 50
    assert periods.periodic_runs(given.limit(0)).collect() == []
