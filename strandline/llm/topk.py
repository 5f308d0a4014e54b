"""Exact top-k search by inner product: cover trees over queries and data, walked together."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import stash

BLOCK = 8192  # rows of data, and of queries, that one task compares
SMALL_BLOCK = 512
MOST_PIVOTS = 256  # rows that blocks are made around
PIVOT_VALUES = 1 << 22  # of all pivots together
SHELLS = 8  # that the rows around a pivot are parted into, each reaching twice as far as the one before
FIRST_NODES = 16  # near a group of queries, of which each query first looks into one
MOST_PAIRS = 1 << 20  # pairs of query and data blocks whose list is broadcast
LEAF = 128
FANOUT = 16
LEAST, MOST = -(2**63), 2**63 - 1  # scores
EXACT = 2.0**26  # norm below which all products of two vectors, and their sums, are exact in doubles


@dataclass
class Node:
    """A ball: its center is a row, all its rows lie within ``radius`` of it. A leaf has no children."""

    center: int
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> Node:
    """A cover tree over the rows of ``points``.

    A node's children are centered on rows picked farthest first, its own center before all, until every row
    lies within half the node's radius of one or there are ``FANOUT``. So centers of siblings are apart
    and balls shrink from level to level. A node of at most ``LEAF`` rows, or of equal ones, is a leaf.
    """

    def distances(rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[center]) ** 2).sum(1))

    def grow(rows: np.ndarray, center: int, far: np.ndarray) -> Node:
        node = Node(center, float(far.max()), rows)
        if len(rows) <= LEAF or node.radius == 0:
            return node
        centers, nearest, owner = [center], far.copy(), np.zeros(len(rows), np.int64)
        while len(centers) < FANOUT and nearest.max() > node.radius / 2:
            centers.append(int(rows[nearest.argmax()]))
            new = distances(rows, centers[-1])
            closer = new < nearest
            nearest[closer], owner[closer] = new[closer], len(centers) - 1
        if len(centers) == 1:
            return node
        node.children = [grow(rows[owner == n], c, nearest[owner == n]) for n, c in enumerate(centers) if (owner == n).any()]
        return node

    rows = np.arange(len(points))
    return grow(rows, 0, distances(rows, 0))


class Search:
    """The best ``k`` rows of ``data`` for each row of ``queries``, by inner product, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, data: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None):
        """``own`` has, for each query, the row of ``data`` that is the query itself, or -1; ``data`` is in order of id.

        Rows that score below ``floor``, which has a score for each query, need not be found.
        """
        self.queries, self.data, self.own, self.k = queries, data, own, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.query_norms, self.norms = norms(queries), norms(data)

    def run(self) -> None:
        self._descend(cover_tree(self.queries), [cover_tree(self.data)])

    def _bound(self, query: Node, node: Node) -> float:
        """No query of ``query`` scores higher with any row of ``node``."""
        middle = float(self.queries[query.center] @ self.data[node.center])
        q, d = self.query_norms[query.center], self.norms[node.center]
        top = middle + query.radius * d + node.radius * q + query.radius * node.radius
        top += 1e-9 * (abs(middle) + (q + query.radius) * (d + node.radius))
        return np.inf if np.isnan(top) else float(top)

    def _worst(self, queries: np.ndarray) -> np.ndarray:
        """The score that a row has to reach to count, for each of some queries."""
        return np.maximum(self.scores[queries, -1], self.floor[queries])

    def _descend(self, query: Node, nodes: list[Node]) -> None:
        """Meet ``query`` with ``nodes``: pairs that cannot beat the group's worst k-th score are left out."""
        if query.children:
            worst = self._worst(query.rows).min()
            wide = [c for n in nodes for c in (n.children if n.radius > query.radius and n.children else [n])]
            left = [n for n in wide if not self._bound(query, n) < worst]
            for child in query.children:
                self._descend(child, left)
            return
        heap = [(-self._bound(query, n), n.center, n.radius, id(n), n) for n in nodes]
        heapq.heapify(heap)
        while heap and not -heap[0][0] < self._worst(query.rows).min():
            node = heapq.heappop(heap)[-1]
            if not node.children:
                self._compare(query.rows, node.rows)
            for n in node.children:
                heapq.heappush(heap, (-self._bound(query, n), n.center, n.radius, id(n), n))

    def _compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        rows = np.sort(rows)
        for at in range(0, len(rows), 4 * LEAF):  # a leaf of equal rows may be large
            part = rows[at : at + 4 * LEAF]
            scores = self.queries[queries] @ self.data[part].T
            scores[self.own[queries][:, None] == part[None, :]] = -np.inf
            better = (scores >= self._worst(queries)[:, None]).any(1)
            if not better.any():
                continue
            who, scores = queries[better], scores[better]
            first = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
            scores = np.concatenate([self.scores[who], np.take_along_axis(scores, first, 1)], 1)
            found = np.concatenate([self.found[who], part[first]], 1)
            found[np.isneginf(scores)] = len(self.data)
            order = np.lexsort((found, -scores), axis=1)[:, : self.k]
            self.scores[who] = np.take_along_axis(scores, order, 1)
            self.found[who] = np.take_along_axis(found, order, 1)


class LargeSearch(Search):
    """The same where products pass what doubles hold exactly. Doubles tell which rows may count; those are scored by integers."""

    def __init__(self, *given):
        super().__init__(*given)
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.queries]

    def _compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), LEAF):
            part = rows[at : at + LEAF]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = self.queries[queries] @ self.data[part].T
                slack = 2.0**-40 * self.query_norms[queries][:, None] * self.norms[part][None, :]
                fit = ~(scores + slack < self._worst(queries)[:, None]) & (self.own[queries][:, None] != part[None, :])
            for q, j in zip(*np.nonzero(fit)):
                query, row = int(queries[q]), int(part[j])
                if scores[q, j] + slack[q, j] < self._worst(queries[q : q + 1])[0]:
                    continue
                exact = max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(self.queries[query], self.data[row]))))
                best = self.best[query] = sorted([*self.best[query], (-exact, row)])[: self.k]
                if len(best) == self.k:
                    self.scores[query, -1] = _below(-best[-1][0])


def _below(score: int) -> float:
    """A double that is not above a score; what is held to the least bigint may be less."""
    return -np.inf if score == LEAST else float(score) - abs(float(score)) * 2.0**-50


def norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows**2).sum(1))


def best_of(queries: np.ndarray, data: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Queries, rows of ``data`` and their scores: for each query its ``k`` best rows at least, if they reach its ``floor``.

    Rows and queries with large components are searched apart, so that few of them cost the others nothing.
    """
    big_query, big = ~(norms(queries) < EXACT), ~(norms(data) < EXACT)
    for of, among in ((~big_query, ~big), (np.ones(len(queries), bool), big), (big_query, ~big)):
        who, rows = np.flatnonzero(of), np.flatnonzero(among)
        if not len(who) or not len(rows):
            continue
        place = np.full(len(data) + 1, -1)
        place[rows] = np.arange(len(rows))
        small = not big_query[who].any() and not big[rows].any()
        search = (Search if small else LargeSearch)(queries[who], data[rows], place[own[who]], k, floor[who])
        search.run()
        if small:
            hit = (search.found >= 0) & (search.found < len(rows))
            q, _ = np.nonzero(hit)
            yield who[q], rows[search.found[hit]], search.scores[hit].astype(np.int64).tolist()
        else:
            flat = [(q, row, -score) for q, best in enumerate(search.best) for score, row in best]
            yield who[[q for q, _, _ in flat]], rows[[row for _, row, _ in flat]], [s for _, _, s in flat]


def whole_numbers(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``id``, ``row``, ``size`` and ``coords`` (doubles as bytes) of vectors with components floored after scaling.

    Vectors that are null or hold a null or non-finite component are left out, and rows without id.
    """

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten()
            values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            sizes = np.array(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[ends] == bad[ends - sizes]) & np.array(lists.is_valid()) & np.array(batch.column("id").is_valid())
            with np.errstate(invalid="ignore"):
                values = np.floor(values * scale)
            coords = [values[e - s : e].tobytes() for e, s in zip(ends[good], sizes[good])]
            keep = pa.array(np.flatnonzero(good))
            arrays = [batch.column("id").take(keep), batch.column("row").take(keep), pa.array(sizes[good]), pa.array(coords, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "size", "coords"])

    given = vectors.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vector).alias("vector"))
    return given.mapInArrow(floored, "id long, row long, size long, coords binary")


@dataclass
class Pivots:
    """Rows that blocks are made around, by vector length, and how far a first shell reaches."""

    points: dict[int, np.ndarray]
    first: dict[int, int]
    reach: float

    def nearest(self, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest pivot (-1 if there are none of its length) and the distance, a little more rather than less."""
        points = self.points.get(rows.shape[1])
        if points is None:
            return np.full(len(rows), -1), norms(rows)
        with np.errstate(over="ignore", invalid="ignore"):
            points = points[:most]
            square = (rows**2).sum(1)[:, None] - 2 * rows @ points.T + (points**2).sum(1)[None, :]
            pivot = np.nan_to_num(square, nan=np.inf, posinf=np.inf).argmin(1)
            return pivot + self.first[rows.shape[1]], norms(rows - points[pivot]) * (1 + 1e-9)

    def shell(self, distance: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            steps = np.ceil(np.log2(distance / self.reach)) if self.reach > 0 else np.where(distance > 0, SHELLS, 0)
        return np.nan_to_num(steps, nan=SHELLS, neginf=0, posinf=SHELLS).clip(0, SHELLS - 1).astype(np.int64)

    def center(self, pivot: int) -> np.ndarray | None:
        for size, first in self.first.items():
            if first <= pivot < first + len(self.points[size]):
                return self.points[size][pivot - first]
        return None


def _matrix(coords: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(coords.to_pylist()), np.float64).reshape(len(coords), size)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the length of their vectors, each with its vectors as a matrix."""
    size = batch.column("size").to_numpy()
    for one in np.unique(size):
        some = batch.take(pa.array(np.flatnonzero(size == one)))
        yield some, _matrix(some.column("coords"), int(one))


def _pivots(given: DataFrame, count: int, widest: int) -> Pivots:
    """At most ``count`` pivots: the rows with the smallest hash."""
    count = max(1, min(count, MOST_PIVOTS, PIVOT_VALUES // max(1, widest)))
    rows = given.orderBy(F.xxhash64("row", F.lit(2)), "row").limit(count).select("size", "coords").collect()
    points: dict[int, list[np.ndarray]] = {}
    for r in rows:
        points.setdefault(r["size"], []).append(np.frombuffer(r["coords"], np.float64))
    first, at = {}, 0
    for size in sorted(points):
        first[size], at = at, at + len(points[size])
    found = Pivots({s: np.stack(p) for s, p in points.items()}, first, 0.0)
    with np.errstate(invalid="ignore", over="ignore"):
        gaps = [np.sort(norms(p - p[n]))[1:2] for p in found.points.values() for n in range(len(p))]
    gaps = np.concatenate(gaps) if gaps else np.zeros(0)
    found.reach = float(np.median(gaps[np.isfinite(gaps)])) / 2 if np.isfinite(gaps).any() else 0.0
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best rows for each query row, by the inner product of their floored components.

    ``is_query`` says by the column ``id`` (the key) which rows are queries; candidates are all rows but the query's own.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; fewer than ``k`` where there are fewer
    candidates; ties go to the smaller id.

    Rows are dealt to nodes: the nearest of at most ``MOST_PIVOTS`` rows and one of ``SHELLS`` shells around it, as in the upper levels of a cover
    tree; so an outlier widens no node but its own. Nodes are cut into blocks of bounded size, queries into blocks
    around a pivot. A first round meets each query with one block near it, for a k-th score. Then a query goes to those nodes
    only whose covering radius allows that score, and a block of data to the query blocks that ask for it. In each meeting cover trees over
    both sides are walked together: a pair of nodes is left out when the covering radii bound every score in it below the worst
    k-th score of the node's queries. Results are merged per query. The sample of pivots decides where rows meet, not what is found.

    Scores are exact: doubles where all products stay below 2**53, integers for the rows in question else, held to the
    range of a bigint. Vectors of another length are no candidates. Rows with the same id are candidates for one
    another. Vectors that take no part are those of ``whole_numbers``; extra columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = stash(whole_numbers(vectors, scale, key, vector), "vectors")
    known = given.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("queries"), F.max("size").alias("widest")).first()
    partitions = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(known["rows"] / BLOCK), min(partitions, math.ceil(known["rows"] / SMALL_BLOCK)))
    pivots = _pivots(given, blocks, known["widest"] or 0)
    groups = min(MOST_PIVOTS, max(1, math.ceil(known["queries"] / BLOCK)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, rows in _by_size(batch):
                pivot, distance = pivots.nearest(rows)
                node = np.where(pivot < 0, -1, pivot * SHELLS + pivots.shell(distance))
                group = pivots.nearest(rows, groups)[0]
                columns = [pa.array(node), pa.array(group), pa.array(distance)]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], [*some.schema.names, "node", "group", "distance"])

    kind = "id long, row long, size long, coords binary"
    placed = stash(given.mapInArrow(dealt, kind + ", node long, group long, distance double"), "dealt")
    # A row a node and a query group: at most MOST_PIVOTS * SHELLS + 1 and MOST_PIVOTS + 1.
    nodes = {r["node"]: r for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    asking = {r["group"]: r["n"] for r in placed.where(is_query).groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = {n: math.ceil(r["n"] / BLOCK) for n, r in nodes.items()}
    query_cuts = {g: math.ceil(n / BLOCK) for g, n in asking.items()}
    data = _cut(placed, "node", cuts, "block").select("id", "row", "size", "coords", "node", "block")
    asked = _cut(placed.where(is_query), "group", query_cuts, "query_block").select("id", "row", "size", "coords", "group", "query_block")

    centers = {n: pivots.center(n // SHELLS) for n, r in nodes.items() if n >= 0 and r["n"] > k}
    first = {}
    for g in asking:
        center = pivots.center(g)
        near = [n for n, c in centers.items() if center is not None and len(c) == len(center)]
        if near:
            with np.errstate(over="ignore", invalid="ignore"):
                first[g] = [near[i] for i in np.argsort(norms(np.stack([centers[n] for n in near]) - center), kind="stable")[:FIRST_NODES]]

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, rows in _by_size(batch):
                group, aim = some.column("group").to_numpy(), np.full(len(rows), -1)
                for g in np.unique(group).tolist():
                    if g in first:
                        with np.errstate(over="ignore", invalid="ignore"):
                            scores = rows[group == g] @ np.stack([centers[n] for n in first[g]]).T
                        aim[group == g] = np.array(first[g])[np.nan_to_num(scores).argmax(1)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(aim)], [*some.schema.names, "node"])

    tried = asked.withColumn("floor", F.lit(float("-inf")))
    if first:
        some = tried.mapInArrow(aimed, kind + ", group long, query_block long, floor double, node long").where("node >= 0")
        some = stash(some.withColumn("block", F.lit(0).cast("long")), "first-queries")
        found = _met(data.where(F.col("block") == 0), some, k)
        worst = found.groupBy("query_row").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
        # Somewhat less where scores are no longer exact as doubles.
        score = F.element_at("scores", k).cast("double")
        worst = worst.where((F.size("scores") >= k) & (F.element_at("scores", k) > LEAST)).select(F.col("query_row").alias("row"), (score - F.abs(score) * 2.0**-50).alias("worst"))
        tried = asked.join(stash(worst, "first-scores"), "row", "left").withColumn("floor", F.coalesce("worst", F.lit(float("-inf"))))

    wanted = {n: (pivots.center(n // SHELLS) if n >= 0 else None, float(r["radius"])) for n, r in nodes.items()}

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, rows in _by_size(batch):
                allowed = [n for n, (center, _) in wanted.items() if (center is None) == (rows.shape[1] not in pivots.points) and (center is None or len(center) == rows.shape[1])]
                if rows.shape[1] in pivots.points and allowed:
                    centers, radii = np.stack([wanted[n][0] for n in allowed]), np.array([wanted[n][1] for n in allowed])
                    with np.errstate(over="ignore", invalid="ignore"):
                        middle, size = rows @ centers.T, norms(rows)
                        top = middle + size[:, None] * radii + 1e-9 * (np.abs(middle) + size[:, None] * (norms(centers) + radii))
                    fit = ~(top < some.column("floor").to_numpy()[:, None])
                else:
                    fit = np.ones((len(rows), len(allowed)), bool)
                lists = pa.array([[allowed[j] for j in np.flatnonzero(f)] for f in fit], pa.list_(pa.int64()))
                names = ["id", "row", "size", "coords", "query_block", "floor"]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), lists], [*names, "nodes"])

    sent = tried.mapInArrow(passing, kind + ", query_block long, floor double, nodes array<long>")
    sent = stash(sent, "queries")
    every = _by_number(cuts or {0: 1})
    some = sent.withColumn("node", F.explode("nodes")).drop("nodes")
    some = some.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), every[F.col("node")] - 1)))
    met = _met(data, some, k)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cut(rows: DataFrame, by: str, cuts: dict[int, int], name: str) -> DataFrame:
    """``rows`` of each node or group cut into blocks by a hash: ``name`` counts them, for groups of queries through all groups."""
    part = F.pmod(F.xxhash64("row"), F.greatest(_by_number(cuts or {0: 1})[F.col(by)], F.lit(1)))
    return rows.withColumn(name, F.col(by) * (1 << 32) + part if by == "group" else part)


def _by_number(values: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x).cast("long") for pair in values.items() for x in pair))


def meetings(asked: DataFrame) -> DataFrame:
    """The pairs of query and data blocks (``query_block``, ``node``, ``block``) that meet: those some query asks for."""
    return asked.select("query_block", "node", "block").distinct()


def _met(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """For each query of ``asked`` its best rows of the blocks that it names: ``query_id``, ``query_row``, ``vec_id``, ``row``, ``score``."""
    pairs = stash(meetings(asked), "meetings")
    few = pairs.count() <= MOST_PAIRS
    called = data.join(F.broadcast(pairs) if few else pairs, ["node", "block"])
    columns = ["id", "row", "size", "coords", "node", "block", "query_block", "floor", "query"]
    called = called.withColumn("floor", F.lit(0.0)).withColumn("query", F.lit(False)).select(columns)
    asked = asked.withColumn("query", F.lit(True)).select(columns)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        query = np.array(group["query"])
        ids, row, size = group["id"].to_numpy(), group["row"].to_numpy(), int(group["size"][0].as_py())
        coords = _matrix(group["coords"], size)
        d = np.flatnonzero(~query)
        d, q = d[np.lexsort((row[d], ids[d]))], np.flatnonzero(query)
        if not len(d) or not len(q):
            return FOUND.empty_table()
        place = dict(zip(row[d].tolist(), range(len(d))))
        own = np.array([place.get(r, -1) for r in row[q].tolist()], np.int64)
        out = []
        for who, best, scores in best_of(coords[q], coords[d], own, k, group["floor"].to_numpy()[q]):
            a, b = q[who], d[best]
            out.append(pa.table([pa.array(ids[a]), pa.array(row[a]), pa.array(ids[b]), pa.array(row[b]), pa.array(scores, pa.int64())], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return called.unionByName(asked).groupBy("size", "query_block", "node", "block").applyInArrow(compare, "query_id long, query_row long, vec_id long, row long, score long")


FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
