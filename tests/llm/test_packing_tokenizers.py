"""Ids of tokenizer files that treat texts otherwise than the one whose units are looked up."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello  World's END", "", "tabs\tand\n\nlines ", "\u00c9t\u00e9 e\u0301 123 a.b!c", "<|endoftext|> x <|", None, "word " * 3000]


def _changed(folder, change):
    with open(WORDS, encoding="utf-8") as file:
        known = json.load(file)
    change(known)
    path = folder / "changed.json"
    path.write_text(json.dumps(known), encoding="utf-8")
    return str(path)


CHANGES = {
    "case": lambda k: k["normalizer"]["normalizers"].pop(),
    "no normalizer": lambda k: k.update(normalizer=None),
    "split": lambda k: k["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\\S+"),
    "added token": lambda k: k["added_tokens"].append(k["added_tokens"][0] | {"id": 49408, "content": "world", "special": False}),
    "truncation": lambda k: k.update(truncation={"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}),
}


def _check(path, by_units):
    assert packing.by_units(path) is by_units
    units = packing._units(path)
    assert isinstance(units, packing.UnitIds if by_units else packing.WholeIds)
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    found = dict((n, ids) for n, ids in packing.encoded(units, pa.array(TEXTS, pa.string())))
    for n, text in enumerate(TEXTS):
        wanted = plain.encode(text or "", add_special_tokens=False).ids + [packing.END]
        assert np.array_equal(found[n], wanted)


@pytest.mark.parametrize("name", CHANGES)
def test_changed_files(tmp_path, name):
    _check(_changed(tmp_path, CHANGES[name]), name == "truncation")


@pytest.mark.parametrize("name, by_units", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_given_files(name, by_units):
    _check(public_tokenizers.path(name), by_units)


def test_long_texts_are_whole_where_slices_would_show(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "one  two   three\n" * 50
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "SLICE", 64)
    (_, ids), = packing.encoded(packing.WholeIds(path), pa.array([text]))
    assert ids.tolist() == [*whole, packing.END]
