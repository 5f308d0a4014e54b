"""Blocks around pivots: which of them meet, and results against all pairs in Python's integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import topk


def by_all_pairs(rows, k=5, every=50):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    expected = {}
    for q, (i, v) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for n, (j, w) in enumerate(whole) if n != q)
            expected[i] = [(j, -s) for s, j in scored[:k]]
    return expected


def found(spark, rows, parts=4, every=50):
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(parts)
    got = {}
    for r in sorted(topk.nearest(given, F.col("id") % every == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.fixture
def counted(monkeypatch):
    """Pairs of blocks that meet in the last round, and all there could be."""
    seen = []
    plain = topk.meetings

    def meetings(asked):
        pairs = plain(asked)
        seen.append((pairs.count(), pairs.select("query_block").distinct().count(), pairs.select("node", "block").distinct().count()))
        return pairs

    monkeypatch.setattr(topk, "meetings", meetings)
    return seen


def clusters(rng, count, each, size=16):
    centers = rng.normal(0, 40, (count, size))
    points = np.concatenate([c + rng.normal(0, 0.5, (each, size)) for c in centers])
    return list(enumerate(rng.permutation(points).tolist()))


def test_clusters_meet_few_blocks(spark, monkeypatch, counted):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "SMALL_BLOCK", 60)
    rows = clusters(np.random.default_rng(1), 8, 150)
    assert found(spark, rows, every=2) == by_all_pairs(rows, every=2)
    pairs, groups, blocks = counted[-1]
    assert groups >= 10 and blocks >= 20 and pairs < groups * blocks / 3


def test_an_outlier_widens_no_block(spark, monkeypatch, counted):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "SMALL_BLOCK", 60)
    rows = clusters(np.random.default_rng(2), 12, 80)
    assert found(spark, rows, every=4) == by_all_pairs(rows, every=4)
    pairs, groups, blocks = counted[-1]
    far = [*rows, (10_001, [-1e5] + [0.0] * 15), (10_003, [0.0, 3e12] + [0.0] * 14)]
    assert found(spark, far, every=4) == by_all_pairs(far, every=4)
    assert counted[-1][0] / counted[-1][1] / counted[-1][2] < 1.3 * pairs / groups / blocks


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9, 1e30, 1e200])
def test_exact_scores_at_every_size(spark, monkeypatch, scale):
    """Beside sums that doubles hold exactly: integers for some rows, for all, and past a bigint."""
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(n, (rng.integers(-900, 900, 6) * (scale if n % 3 else 1.0)).tolist()) for n in range(160)]
    rows += [(500 + n, rows[n][1]) for n in range(40)]
    assert found(spark, rows) == by_all_pairs(rows)


def test_large_search_equals_all_pairs():
    rng = np.random.default_rng(6)
    data = np.floor(rng.normal(0, 2.0**28, (300, 4)))
    search = topk.LargeSearch(data[:30], data, np.arange(30), 5)
    search.run()
    for q in range(30):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(data[q], d)), n) for n, d in enumerate(data) if n != q)
        assert search.best[q] == scored[:5]


def test_every_row_alike(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    rows = [(n, [0.5, -0.25, 1.0]) for n in range(230)]
    assert found(spark, rows) == by_all_pairs(rows)
