"""Operators on skewed rows against plain Spark or plain Python."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins, sets
from strandline.operators.aggregates import blocks, exact_percentile
from strandline.operators.recursion import recurse
from strandline.operators.hot import HOT_ROWS_CONF
from strandline.operators.timewindows import session_starts, sliding_sums
from tests.skewed import rows_of, skewed


@pytest.fixture
def as_dealt(spark):
    """Leave shuffles as they are, so that a test can see how rows are dealt."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def rows(spark):
    return skewed(spark, 1500).cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, rows, split_groups, how):
    some = [(k, f"r{k}") for k in (7, 1, 2, 3, 99, None)] + [(7, "second")]
    right = spark.createDataFrame(some, "k bigint, label string")
    left = rows.select("id", "k")
    got = joins.salted_join(left, right, ["k"], how)
    expected = left.join(right, ["k"], how)
    assert "pieces" not in got.columns
    assert rows_of(got, *expected.columns) == rows_of(expected, *expected.columns)


def test_salted_join_refuses_a_right_join(rows):
    with pytest.raises(ValueError):
        joins.salted_join(rows, rows, ["k"], "right")


def _by_time(rows):
    return [(r["k"], r["ts"], r["id"], r["v"]) for r in rows.collect()]


def test_range_join(rows):
    left = rows.where("id % 2 = 0").select("k", F.col("id").alias("a"), F.col("ts").alias("at"))
    right = rows.where("id % 2 = 1").select("k", F.col("id").alias("b"), F.col("ts").alias("bt"))
    got = joins.range_join(left, right, ["k"], "at", "bt", 3600)
    span = datetime.timedelta(hours=1)
    data = _by_time(rows)
    expected = sorted(
        (a, b)
        for ka, ta, a, _ in data
        if a % 2 == 0 and ka is not None
        for kb, tb, b, _ in data
        if b % 2 == 1 and ka == kb and ta <= tb <= ta + span
    )
    assert sorted((r["a"], r["b"]) for r in got.collect()) == expected
    assert expected


def test_asof_join(rows, split_groups):
    left = rows.where("id % 3 <> 0").select("k", "ts", "id")
    right = rows.where("id % 3 = 0").select("k", "ts", "id", F.col("id").alias("found"), "v")
    got = joins.asof_join(left, right, ["k"], ["ts", "id"], ["ts", "id"], ["found", "v"])
    data = _by_time(rows)
    for r in got.collect():
        before = [(t, i, v) for k, t, i, v in data if i % 3 == 0 and k == r["k"] and t <= r["ts"]]
        latest = max(before, key=lambda x: x[:2]) if before else (None, None, None)
        assert (r["found"], r["v"]) == latest[1:]
    assert got.count() == left.count()


def test_interval_totals(rows, split_groups):
    left = rows.where("id % 2 = 0").select("k", "ts", "id")
    right = rows.where("id % 2 = 1").select("k", "ts", "v")
    sums = {"n": F.lit(1).cast("bigint"), "v": F.coalesce("v", F.lit(0))}
    got = joins.interval_totals(left, right, ["k"], "id", "ts", "ts", 43_200, sums)
    data = _by_time(rows)
    span = datetime.timedelta(seconds=43_200)
    for r in got.join(left.select("id", "ts"), "id").collect():
        near = [
            v or 0
            for k, t, i, v in data
            if i % 2 == 1 and k == r["k"] and r["ts"] - span <= t <= r["ts"]
        ]
        assert (r["n"], r["v"]) == (len(near), sum(near))
    assert got.count() == left.count()


def test_best_per_key(rows):
    got = joins.best_per_key(rows, ["k"], [F.col("ts"), F.col("id")], ["ts", "id"])
    best = {}
    for k, t, i, _ in _by_time(rows):
        best[k] = max(best.get(k, (t, i)), (t, i))
    assert {r["k"]: (r["ts"], r["id"]) for r in got.collect()} == best


def test_exact_percentile(rows, split_groups):
    shares = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p100": 1.0}
    got = exact_percentile(rows, ["k"], "v", shares)
    expected = rows.groupBy("k").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items()))
    found = {r["k"]: r for r in got.collect()}
    for r in expected.where("p0 IS NOT NULL").collect():
        assert [found[r["k"]][n] for n in shares] == pytest.approx([r[n] for n in shares])


def test_blocks_bound_groups(rows, split_groups):
    dealt = blocks(rows, ["k"])
    sizes = dealt.groupBy("k", "block").count()
    assert sizes.agg(F.max("count")).first()[0] < 1.5 * rows.count() / 8
    assert dealt.count() == rows.count()


def test_blocks_split_copies_of_one_row(spark, split_groups):
    copies = spark.range(4000).repartition(40).select(F.lit(1).alias("k"))
    sizes = blocks(copies, ["k"]).groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] < 2000


def test_blocks_leave_small_keys_whole(spark, split_groups):
    small = spark.range(200_000).select((F.col("id") % 100_000).alias("k"), F.create_map("id", "id").alias("m"))
    assert blocks(small, ["k"]).groupBy("k", "block").count().count() == 100_000


def test_salted_join_of_copies(spark, split_groups):
    left = spark.range(4000).repartition(40).select(F.lit(1).alias("k"))
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    joined = joins.salted_join(left, right, ["k"])
    assert [tuple(r) for r in joined.groupBy("k", "name").count().collect()] == [(1, "a", 4000)]


def _multiset(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_set_operations(spark, monkeypatch, chunk):
    monkeypatch.setattr(sets, "CHUNK", chunk)
    rng = random.Random(3)
    make = lambda n: [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice("ab")) for _ in range(n)]
    left = spark.createDataFrame(make(300), "x int, y string")
    right = spark.createDataFrame(make(150), "x int, y string")
    for ours, plain in [
        (sets.union, lambda a, b: a.union(b).distinct()),
        (sets.intersect, lambda a, b: a.intersect(b)),
        (sets.subtract, lambda a, b: a.subtract(b)),
        (sets.intersect_all, lambda a, b: a.intersectAll(b)),
        (sets.subtract_all, lambda a, b: a.exceptAll(b)),
    ]:
        assert _multiset(ours(left, right)) == _multiset(plain(left, right))


def test_recurse_follows_a_tree(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (4, 5), (9, 10)], "a int, b int")
    start = spark.createDataFrame([(1, 0)], "node int, depth int")

    def step(reached):
        joined = reached.join(edges, F.col("node") == F.col("a"))
        return joined.select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))

    got = sorted(tuple(r) for r in recurse(start, step).collect())
    assert got == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]


def test_sessions(rows, split_groups):
    gap = 6 * 3600
    got = session_starts(rows, ["k"], "ts", "id", gap, "opened")
    by_key = {}
    for k, t, i, _ in _by_time(rows):
        by_key.setdefault(k, []).append((t, i))
    expected = {}
    for group in by_key.values():
        opened = previous = None
        for t, i in sorted(group):
            if previous is None or (t - previous).total_seconds() > gap:
                opened = t
            expected[i], previous = opened, t
    assert {r["id"]: r["opened"] for r in got.collect()} == expected


def test_recursion_in_a_circle_ends_with_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    start = spark.createDataFrame([(1,)], "node int")
    with pytest.raises(RuntimeError, match="cycle"):
        recurse(start, lambda r: r.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")), most_rounds=3)


def test_recursion_of_nothing(spark):
    start = spark.createDataFrame([], "node int")
    assert recurse(start, lambda r: r).collect() == []


@pytest.mark.parametrize("size, slide", [("5 hours", "2 hours"), ("1 day", "6 hours"), ("90 minutes", "1 hour"), ("1 hour 30 minutes", "1 hour")])
def test_sliding_sums(rows, size, slide):
    got = sliding_sums(rows, "ts", size, slide, ["k"], {"n": F.lit(1).cast("bigint")})
    expected = rows.groupBy(F.window("ts", size, slide).alias("w"), "k").agg(F.count(F.lit(1)).alias("n"))
    expected = expected.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "k", "n")
    assert rows_of(got, "start", "end", "k", "n") == rows_of(expected, "start", "end", "k", "n")


def test_sliding_sums_refuse_months(rows):
    with pytest.raises(ValueError):
        sliding_sums(rows, "ts", "2 months", "1 month", ["k"], {})


def test_joins_keep_maps_on_small_and_large_keys(spark, rows):
    left = rows.select("id", "k", F.create_map("id", "v").alias("m"))
    right = spark.createDataFrame([(7, "a"), (1, "b")], "k bigint, label string")
    found = []
    for threshold in ("1", "1000000"):
        spark.conf.set(HOT_ROWS_CONF, threshold)
        found.append(rows_of(joins.salted_join(left, right, ["k"]), "id", "k", "m", "label"))
    spark.conf.unset(HOT_ROWS_CONF)
    assert found[0] == found[1]


def test_a_crowded_bucket_is_dealt_out(spark, split_groups, as_dealt):
    """All rows of both sides fall into one bucket of one key."""
    base = spark.range(600).repartition(20).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.lit(7200) + F.col("id") / 1000).cast("timestamp_ntz").alias("t"))
    left, right = base.select("k", F.col("id").alias("a"), F.col("t").alias("at")), base.select("k", F.col("id").alias("b"), F.col("t").alias("bt"))
    pairs = joins.range_join(left, right, ["k"], "at", "bt", 3600)
    parts = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 600 * 601 // 2
    # The bucket is dealt to four pieces, of which chance may send two to one task.
    assert len(parts) >= 2 and max(r["count"] for r in parts) < 0.6 * 600 * 601 // 2


def test_copies_of_large_rows_are_dealt_out(spark, monkeypatch, as_dealt):
    monkeypatch.setattr(sets, "CHUNK", 100)
    many = spark.range(8).select("id").crossJoin(spark.range(2000).select(F.lit(0).alias("z"))).select("id")
    kept = sets.subtract_all(many, spark.range(1).select("id"))
    parts = kept.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 15_999 and max(r["count"] for r in parts) < 2 * 15_999 / 8


def test_money_with_more_decimals_is_refused(spark):
    from strandline.functions import units

    with pytest.raises(Exception, match="decimal places"):
        spark.createDataFrame([(1.005,)], "x double").select(units("x", 2)).collect()
