"""Connected components of links between numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import stash

MOST_ROUNDS = 60


def local_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` numbered things the smallest number it can be reached from over links ``a`` to ``b``."""
    roots = np.arange(count)
    while len(a):
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, before[a], low)
        np.minimum.at(roots, before[b], low)
        while not np.array_equal(roots, deeper := roots[roots]):
            roots = deeper
        open_ = roots[a] != roots[b]
        a, b = a[open_], b[open_]
    return roots


def roots(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node of ``links`` (``a``, ``b``, bigint) but the roots.

    Alternates between linking each node's larger neighbours to its smallest one and linking its smaller
    neighbours to it. Both keep components whole and shorten every path, so a number of rounds of the order
    of the logarithm of the longest path leaves only stars. Minima are added up per task before the
    shuffle; adaptive execution splits a node with many links in the joins. Each round is written to
    the shared scratch folder. Rounds that would not end raise an error.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stash(links, "links")
    known = _mark(links)
    for _ in range(MOST_ROUNDS):
        if not known[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the joins are ones that adaptive execution can split.
        lowest = stash(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("low", "a").alias("low")), "lowest")
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stash(large.distinct(), "links")
        lowest = stash(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        small = large.join(lowest, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stash(small.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, known = known, _mark(links)
        if known == before:
            break
    else:
        raise RuntimeError(f"links are still changing after {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple[int, int]:
    """The number of links and a sum over them that changes with any of them."""
    found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return found[0], int(found[1] or 0)
