"""Repeated windows within one run of a minimiser, whose words are too short to fill it."""

import pytest

from strandline.llm import substrings
from tests.llm import brute

CYCLES = ["ha " * 40, "a " * 40, "1 2 " * 20, "- " * 60, "| - " * 30, "b " * 35, "c " * 36, "x y z " * 13]


@pytest.mark.parametrize("before, after", [("", ""), ("some prose before it ", "and some after it")])
def test_short_cycles_are_repeats(spark, before, after):
    texts = [before + c + after for c in CYCLES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split, gone = brute.without_repeats(texts)
    expected = [(sum(g), " ".join(w for w, x in zip(ws, g) if not x)) for ws, g in zip(split, gone)]
    found = sorted(substrings.without_repeats(docs, with_text=True).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_removed"], r["kept"]) for r in found] == expected
