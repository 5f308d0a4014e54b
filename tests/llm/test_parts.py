"""The pieces that work inside tasks, each against a plain version."""

import random
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandline.llm import packing, pages, quality, simhash, substrings, texts, topk, toxicity
from strandline.llm.components import local_roots
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
ITEMS = st.lists(st.integers(0, 4), max_size=25)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 40])
@settings(max_examples=150, deadline=None)
@given(ITEMS, ITEMS)
def test_longest_common_subsequence(bits, a, b):
    before, pages.BITS_AT_ONCE = pages.BITS_AT_ONCE, bits
    try:
        taken = [x for x, t in zip(a, pages.shared(a, b)) if t]
    finally:
        pages.BITS_AT_ONCE = before
    rest = iter(b)
    assert len(taken) == lcs(a, b) and all(x in rest for x in taken)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b&nbsp;c<br>d", "a & b c d"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<p>t<b>w</b>o</article><footer>f</footer>", "T one two"),
        ("<header>h</header><main>x<aside>no</aside>y</main>", "x y"),
        ("<article><header><h1>T</h1></header>a<div class='comments'>c</div>b<form><p>q</form></article>", "T a b"),
        ("<article>a<script>var x='</p><article>'</script>b<!-- c --><style>p{}</style></article>", "a b"),
        ("<article>1 < 2 and <img src='a>b'> so</article>", "1 < 2 and so"),
        ("<article><p>never closed", "never closed"),
        ("<article><div hidden>x</div><div id=cookie-notice>y</div>z</article>", "z"),
        ("<title>t</title><body>a<script>", "a"),
    ],
)
def test_page_lines(html, text):
    lines = pages.lines_of(html)
    kept = [t for k, t in lines if k == pages.ARTICLE_LINE] or [t for k, t in lines if k == pages.OPEN_LINE]
    # Script and style elements part the words around them in these pages; inline elements do not.
    assert " ".join(kept) == text


def test_long_page_is_linear():
    html = "<article>" + "<p>word " * 20_000 + "<div class=\"" + "x" * 100_000
    lines = pages.lines_of(html)
    assert len(lines) == 20_000
    assert unescape("&amp") == "&"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_least_slack_places_all(lengths):
    sequence, offset = packing.placed(np.array(lengths), 64)
    filled = {}
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths)):
        assert filled.get(s, 0) == o
        filled[s] = o + n
    assert max(filled.values()) <= 64
    assert set(filled) == set(range(len(filled)))


def test_least_slack_first_sequence_is_the_fullest():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(8)]
        chosen, times = next(packing.least_slack({x: lengths.count(x) for x in set(lengths)}, 40))
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(x * n for x, n in chosen.items()) == max(lengths) + max(s for s in sums if s <= 40 - max(lengths))
        assert all(lengths.count(x) >= n * times for x, n in chosen.items())


ODD = [
    "a\x01b \x01 c", "<|endoftext|> x <|ENDOFTEXT|>", "", "  ", None, "x" * 200, "don't it's. İİ é. Σας ΣΑΣ, 12.5%",
    "a,̸ ≮ ... ?!,  nb sp 'sa s's. l'll''d é Á.", "日本語 テキスト。 " * 50, "a\x0bb\x1fc\x85d", "word." * 900,
]


@pytest.mark.parametrize("size", [4 << 20, 64])
def test_ids_are_the_tokenizers(monkeypatch, size):
    monkeypatch.setattr(packing, "SLICE", size)
    monkeypatch.setattr(packing, "UNITS_KEPT", 20)
    units, plain = packing.UnitIds(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        found = dict(packing.encoded(units, pa.array(ODD)))
        for n, text in enumerate(ODD):
            assert found[n].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [packing.END]


@pytest.mark.parametrize("sides", [False, True])
@pytest.mark.parametrize("buckets", [1, 3, 60])
def test_bit_slices_find_all_pairs(monkeypatch, sides, buckets):
    monkeypatch.setattr(simhash, "ENTRIES", 1000)
    rng = np.random.default_rng(buckets)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = base[rng.integers(0, 20, 400)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    bucket = np.sort(rng.integers(0, buckets, 400))
    side = rng.integers(1, 3, 400) if sides else np.zeros(400, int)
    found = {(min(p), max(p)) for a, b in simhash.close(prints, bucket, side) for p in zip(a.tolist(), b.tolist())}
    expected = {
        (i, j)
        for j in range(400)
        for i in range(j)
        if bucket[i] == bucket[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4 and (not sides or side[i] != side[j])
    }
    assert found == expected and expected


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
def test_masks_miss_no_pair(count):
    masks = simhash.bucket_masks(count)
    rng = random.Random(count)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flips for m in masks)


def test_fingerprint():
    for text in ["", "  \t", "one", "One two", "a b c D", "a b c d e f g " * 9, "É é\xa0x y z  w\x0bv", "w " * 70_000]:
        assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=30))
def test_local_roots(pairs):
    found = local_roots(20, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    label = list(range(20))
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found.tolist() == label


def test_repeated_windows():
    rng = random.Random(5)
    rows = [b" ".join(b"w%d" % rng.randint(0, 1) for _ in range(rng.randint(35, 60))) for _ in range(20)]
    rows += [rows[0] + b" end", b"x " + rows[3], b" ".join([b"same"] * 90)]
    split, found = [r.split() for r in rows], substrings.repeated_windows(rows)
    windows = [tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34)]
    assert found.tolist() == [windows.count(w) > 1 for w in windows]


def test_super_kmers_hold_every_window_once():
    rng = random.Random(6)
    docs = [" ".join(str(rng.randint(0, 9)) for _ in range(n)) for n in (0, 34, 35, 36, 500)]
    blob = "".join(docs).encode()
    firsts = np.cumsum([0] + [len(d) for d in docs])[:-1]
    found = substrings.Words(np.frombuffer(blob, np.uint8), firsts)
    first, many, least = substrings.super_kmers(found)
    places = [(int(found.doc[a]), a + k) for a, n in zip(first, many) for k in range(n)]
    assert len(places) == len(set(places)) == sum(max(0, len(d.split()) - 34) for d in docs)
    assert {d for d, _ in places} == {2, 3, 4}


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "line"])
def test_dual_tree_is_exact(kind):
    rng = np.random.default_rng(3)
    data = {
        "spread": rng.integers(-60, 60, (900, 8)),
        "clusters": rng.integers(-90, 90, (6, 8))[rng.integers(0, 6, 900)] + rng.integers(-3, 3, (900, 8)),
        "equal": np.ones((900, 8), int),
        "line": np.outer(2 ** np.arange(40), np.ones(8, int)),
    }[kind].astype(float)
    queries = data[::9]
    own = np.arange(0, len(data), 9)
    search = topk.Search(queries, data, own, 5)
    search.run()
    scores = queries @ data.T
    for n, row in enumerate(scores):
        row[own[n]] = -np.inf
        expected = np.lexsort((np.arange(len(row)), -row))[:5]
        assert search.found[n].tolist() == expected.tolist()


def test_cover_tree_prunes_clusters():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1000, (12, 16))
    data = np.floor(np.concatenate([c + rng.normal(0, 5, (300, 16)) for c in centers]))
    search = topk.Search(data[:100], data, np.arange(100), 5)
    met = []
    compare = search._compare
    search._compare = lambda q, r: (met.append(len(q) * len(r)), compare(q, r))
    search.run()
    assert sum(met) < 0.3 * 100 * len(data)


def test_long_texts_score_like_short_ones(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["alpha", "Beta", "gämma", "δ", "x"]
    docs = pa.array([" ".join(rng.choice(words, n)) for n in (0, 1, 40, 900)] + [None, "", "y" * 5000])
    score = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    whole = toxicity.margins(docs, score)
    for n, text in enumerate(docs.to_pylist()):
        bucket, share = toxicity.bag((text or "").encode())
        assert whole[n] == pytest.approx((score[bucket] * share).sum(), abs=1e-4)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert toxicity.margins(docs, score) == pytest.approx(whole, abs=1e-5)


def test_attention_goes_on_over_slices(monkeypatch):
    rng = np.random.default_rng(2)
    bags = [rng.random((n, quality.FEATURES), np.float32) for n in (1, 3, 9, 2)]
    model = quality.train(bags, [0, 1, 1, 0], [1.0] * 4, rounds=2)
    text = ("word, " * 47 + "END ") * 300
    docs = pa.array([text, None, "", "one", " "])
    whole = quality.scores(docs, model)
    assert whole[1] == whole[2] == whole[4] and 0 < whole.min() and whole.max() < 1
    monkeypatch.setattr(quality, "SLICE", 2048)
    assert quality.scores(docs[:1], model)[0] == pytest.approx(whole[0], abs=1e-6)


@pytest.mark.parametrize("size", [1, 700, 1024, 5000])
def test_slices_have_the_passages_of_the_whole(monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(quality, "SLICE", size)
    for text in ("x" * 9000, " " * 5000 + "a " * 400 + "b" * 3000 + "\n" * 4000 + "c", "".join(rng.choice("ab  \n") for _ in range(20_000)), "word " * 3000, "  "):
        data = np.frombuffer(b"before " + text.encode() + b"after", np.uint8)
        whole, _ = quality.passages(data, np.array([7]), np.array([7 + len(text)]))
        assert np.array_equal(np.concatenate(list(quality.slices(data, 7, 7 + len(text)))), whole)


def test_passages_do_not_depend_on_their_neighbours():
    texts_ = [b"one two", b"", b"three" * 900, b" ", b"four\n" * 100]
    data, ends = np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([len(t) for t in texts_])
    found, owner = quality.passages(data, ends - [len(t) for t in texts_], ends)
    for n, text in enumerate(texts_):
        alone, _ = quality.passages(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
        assert np.array_equal(found[owner == n], alone)
    assert np.bincount(owner)[2] > 3  # a word without end has bounded passages


def test_gradient_of_attention():
    """A step along the slopes lowers the loss of a bag whose label is wrong."""
    rng = np.random.default_rng(3)
    bags = [rng.random((4, quality.FEATURES), np.float32) + y for y in (0, 1) for _ in range(20)]
    labels = [0] * 20 + [1] * 20
    model = quality.train(bags, labels, [1.0] * 40, rounds=30)
    for found, y in zip(bags, labels):
        *_, coded, _, _, raw = model.hidden(found)
        share = np.exp(raw - raw.max())
        logit = (share / share.sum()) @ coded @ model.head + model.bias[0]
        assert (logit > 0) == (y == 1)


def test_raw_bytes_of_a_slice():
    column = pa.array(["ab", None, "", "çd", "x"]).slice(1, 3)
    data, starts, ends = texts.raw(column)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["", "", "çd"]
