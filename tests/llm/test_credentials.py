"""Secrets: spans against the patterns as they are stated, and values sorted out by their owners."""

import hashlib
import re

import pytest

from strandline.llm import credentials
from tests.llm import brute

WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
PLAIN = [
    (rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
KEY = "AKIA" + "Q7ZX2M9RT4WB8LKD"
HASH = "9f14a7029c8514dfe98aba92898d323168e199da"
TOKEN = "gX4k9TqLm2ZrV7bNs0Wd"


def base(text):
    found = [(m.start(), k, m.end()) for k, (p, fits) in enumerate(PLAIN) for m in re.finditer(p, text) if fits(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


TEXTS = [
    "Token = \"%s\" and PASSWORD: hunter22" % HASH, "secret: token: abcdefgh", "api_key=APIKEY=aPi_KeY==x1", f"{KEY}{KEY} {KEY.lower()} AKIAshort {KEY}",
    "0" * 23 + "g" + "a" * 24 + "A" + "f" * 60, "ſecret = abcdefgh toKen = abcdefgh toKen=abcdefgh", "passwd'   =   'x.y/z+_-= token=ab password=abcdef",
    "", " ", None, "é" * 50 + "passwd:" + "p" * 200_000, "token" + " " * 5000 + "=  \"abc_def\"", "pass word: abcdef secret\t=abcdef secret =\nabcdef", "x" * 100_000 + HASH * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "one") for n, t in enumerate(TEXTS)] + [(None, TEXTS[0], None), (0, TEXTS[0], "one")]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, owner int, spans int, row int").repartition(3)


def test_spans_by_pattern(docs):
    found = credentials.secrets(docs).collect()
    expected = {n: base(t or "") for n, t in enumerate(TEXTS)} | {None: base(TEXTS[0])}
    assert len(found) == len(TEXTS) + 2
    for r in found:
        want = expected[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("token")] == [s for s in want.split(",") if s]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")]
    assert sum(r["n_assign"] for r in found) > 8
    assert credentials.secrets(docs.limit(0)).collect() == []


def test_values_are_sorted_out_by_owner(spark):
    """A value of many owners is an example; one in many repositories of one owner too; what looks live and is neither is owned."""
    rows = [(n, f"see {TOKEN} or token={HASH}", "abc"[n % 3]) for n in range(9)]
    rows += [(100 + n, f"key {TOKEN[::-1]} for {KEY}", "ab"[n % 2]) for n in range(6)]
    rows += [(200 + n, f"password=Ab3{'xyzuvwrs' * 2} by {TOKEN.swapcase()}", "a") for n in range(25)]
    rows += [(300, "password=changeme aB3aB3aB3aB3aB3aB3aB3", "z")]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r["doc_id"]: r for r in credentials.secrets(given).collect()}
    for r in (found[n] for n in range(9)):
        assert (r["n_token"], r["n_owned"], r["copied"]) == (0, 0, r["spans"]) and r["spans"]
    for r in (found[n] for n in range(100, 106)):
        assert (r["n_token"], r["n_access"], r["n_copied"]) == (1, 1, 0) and r["owned"] == r["spans"] == f"token:4:24,access:29:{29 + len(KEY)}"
    for r in (found[n] for n in range(200, 225)):
        assert (r["n_token"], r["n_owned"], r["n_copied"]) == (0, 0, 1)
    assert (found[300]["spans"], found[300]["n_owned"], found[300]["n_copied"]) == ("assign:0:17", 0, 0)


def test_ownership_counts(spark):
    rows = [(b"v", "a", "1"), (b"v", "a", "1"), (b"v", "a", "2"), (b"v", "b", "1"), (b"v", None, None), (b"w", "a", None), (b"w", "a", None)]
    given = spark.createDataFrame(rows, "value binary, owner string, repository string")
    assert {bytes(r["value"]): (r["owners"], r["repositories"]) for r in credentials.ownership(given).collect()} == {b"v": (3, 4), b"w": (1, 1)}


def test_a_long_text_of_many_secrets(spark):
    text = " ".join(f"token={brute.xxhash.xxh3_128_hexdigest(str(i))}" for i in range(3000))
    given = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    row = credentials.secrets(given).first()
    assert (row["n_assign"], row["n_hex"]) == (3000, 3000)
    assert ",".join(s for s in row["spans"].split(",")) == base(text)
