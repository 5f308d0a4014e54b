"""Split plans against Spark's own windows on skewed rows."""

import pytest
from pyspark.sql import Window, functions as F

from strandline.operators import windows
from strandline.operators.hot import HOT_ROWS_CONF, HOT_ROWS_MOST_CONF, hot_groups
from strandline.operators.scan import Wanted, find_split, scan
from tests.skewed import rows_of, skewed


@pytest.fixture(scope="module")
def rows(spark):
    return skewed(spark).cache()


def test_fixture_has_hot_groups(rows, split_groups):
    hot = {r["__group"]["k"] for r in hot_groups(rows, ["k"]).collect()}
    assert {7, None} <= hot


def test_small_groups_stay_whole(rows):
    assert hot_groups(rows, ["k"]) is None


@pytest.mark.parametrize(
    "keys, order",
    [(["k"], ["x", "id"]), (["k"], ["v", "id"]), (["k", "name"], ["ts", "id"]), ([], ["x", "id"])],
)
@pytest.mark.parametrize("sample", [100, 500_000])
def test_scan(rows, split_groups, monkeypatch, order, keys, sample):
    monkeypatch.setattr("strandline.operators.scan.SAMPLE_ROWS", sample)
    wanted = Wanted(
        sums={"nth": F.lit(1).cast("bigint"), "sum_v": F.col("v")},
        totals={"all_v": F.col("v"), "of": F.lit(1).cast("bigint")},
        lasts={"last_v": F.col("v")},
        firsts={"first_v": F.col("v")},
        lags={"lag_v": F.col("v"), "lag_name": F.col("name")},
        leads={"lead_v": F.col("v")},
    )
    got = scan(rows, keys, order, wanted)
    plain = scan(rows, keys, order, wanted, split=None)
    assert got.dtypes == plain.dtypes
    assert rows_of(got, *got.columns) == rows_of(plain, *got.columns)


@pytest.mark.parametrize("order", ["x", "v", "ts"])
def test_peer_ranks(rows, split_groups, order):
    got = windows.peer_ranks(rows, ["k"], order)
    w = Window.partitionBy("k").orderBy(order)
    expected = rows.select(
        "id",
        F.rank().over(w).alias("rank"),
        F.dense_rank().over(w).alias("dense_rank"),
        F.percent_rank().over(w).alias("percent_rank"),
        F.cume_dist().over(w).alias("cume_dist"),
    )
    assert rows_of(got, *expected.columns) == rows_of(expected, *expected.columns)


@pytest.mark.parametrize("n", [1, 4, 7, 2000])
def test_tiles(rows, split_groups, n):
    got = windows.tiles(rows, ["k"], ["x", "id"], n, "tile")
    w = Window.partitionBy("k").orderBy("x", "id")
    expected = rows.withColumn("tile", F.ntile(n).over(w))
    assert rows_of(got, "id", "tile") == rows_of(expected, "id", "tile")


@pytest.mark.parametrize("block", [10, 64])
def test_moving_rows(rows, split_groups, block):
    aggs = {"s": F.sum("v"), "m": F.max("v"), "n": F.count(F.lit(1))}
    got = windows.moving_rows(rows, ["k"], ["ts", "id"], 6, aggs, block=block)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-6, 0)
    expected = rows.select("id", *(a.over(w).alias(n) for n, a in aggs.items()))
    assert rows_of(got, *expected.columns) == rows_of(expected, *expected.columns)


@pytest.mark.parametrize("seconds", [3600, 86_400])
def test_moving_range_sums(rows, split_groups, seconds):
    sums = {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1).cast("bigint")}
    got = windows.moving_range_sums(rows, ["k"], "ts", "id", seconds, sums)
    rows.createOrReplaceTempView("skewed_rows")
    expected = rows.sparkSession.sql(
        f"""SELECT id, sum(coalesce(v, 0)) OVER w AS s, count(*) OVER w AS n FROM skewed_rows
        WINDOW w AS (PARTITION BY k ORDER BY ts
            RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"""
    )
    assert rows_of(got, *expected.columns) == rows_of(expected, *expected.columns)


def test_segments_of_hot_groups_are_small(rows, split_groups):
    """The largest piece any task sees is a small part of the hot group."""
    from strandline.operators.scan import _with_segment

    split = find_split(rows, [], ["x", "id"])
    marked = rows.withColumn("__hot", F.lit(True))
    sizes = _with_segment(marked, ["x", "id"], split.cuts).groupBy("__segment").count()
    largest = sizes.where("__segment >= 0").agg(F.max("count")).first()[0]
    assert rows.where("x = 5").count() > rows.count() / 3
    assert largest < rows.count() / 10


@pytest.mark.parametrize("order", [["name", "id"], ["flag", "id"], ["name", "x"]])
def test_text_and_boolean_orders_on_small_and_large_groups(rows, spark, order):
    """The same call gives the same rows with whole groups and with split ones."""
    given = rows.withColumn("flag", F.col("v") > 500).withColumn("m", F.create_map("id", "k"))
    given = given.withColumn("name", F.when(F.col("id") % 50 == 0, None).otherwise(F.concat("name", (F.col("id") % 300).cast("string"))))
    order = order if order[-1] == "id" else [*order, "id"]
    found = []
    for threshold in ("1", "1000000"):
        spark.conf.set(HOT_ROWS_CONF, threshold)
        numbered = windows.row_numbers(given, ["k"], order, "nth")
        found.append(rows_of(windows.row_numbers(numbered.drop("m"), [], order, "place"), "id", "nth", "place"))
        assert "m" in numbered.columns
    spark.conf.unset(HOT_ROWS_CONF)
    w = Window.partitionBy("k").orderBy(*order)
    expected = given.select("id", F.row_number().over(w).alias("nth"), F.row_number().over(Window.orderBy(*order)).alias("place"))
    assert found[0] == found[1] == rows_of(expected, "id", "nth", "place")


def test_text_ranks_on_small_and_large_groups(rows, spark):
    found = []
    for threshold in ("1", "1000000"):
        spark.conf.set(HOT_ROWS_CONF, threshold)
        found.append(rows_of(windows.peer_ranks(rows, ["k"], "name"), "id", "rank", "dense_rank", "percent_rank", "cume_dist"))
    spark.conf.unset(HOT_ROWS_CONF)
    assert found[0] == found[1]


def test_orders_that_cannot_be_cut_are_refused_at_any_size(rows):
    with pytest.raises(ValueError, match="cannot cut groups"):
        windows.row_numbers(rows.withColumn("s", F.struct("x")), ["k"], ["s", "id"], "nth")


def test_hot_threshold_has_a_ceiling(rows, spark):
    spark.conf.set(HOT_ROWS_CONF, "1")
    spark.conf.set(HOT_ROWS_MOST_CONF, "20")
    try:
        assert hot_groups(rows, ["k"]).count() > 8
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(HOT_ROWS_MOST_CONF)


def test_numbering_a_table_sends_no_rows_to_a_single_task(spark, rows):
    """Only the segments' sums, of which there is a bounded number, meet in one task."""
    plan = windows.row_numbers(rows, [], ["ts", "id"], "place")._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [n for n, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert all("HashAggregate" in plan[n + 1] and "__segment" in plan[n + 1] for n in single)
    assert len(single) == 1 and sum("Window " in line or "Window [" in line for line in plan) >= 2


def test_a_crowded_time_is_one_row_of_the_scan(spark, split_groups, monkeypatch):
    """Four rows of five have one time. What the scan gets is cut evenly all the same."""
    from strandline.operators import joins

    crowded = spark.range(20_000).select(
        "id", (F.col("id") % 2).alias("k"), F.timestamp_seconds(F.when(F.col("id") % 5 > 0, 86_400).otherwise(F.col("id"))).cast("timestamp_ntz").alias("ts")
    )
    scanned = []
    monkeypatch.setattr(joins, "scan", lambda df, *a, **k: (scanned.append(df.count()), scan(df, *a, **k))[1])
    got = windows.moving_range_sums(crowded, ["k"], "ts", "id", 60, {"n": F.lit(1).cast("bigint")})
    assert got.where("id = 1").first()["n"] == 8_000
    assert got.count() == 20_000
    assert scanned[0] < 16_000


def test_sketch_finds_every_hot_group(spark, split_groups, monkeypatch):
    """Many keys, some just above and some just below what is hot, with a sketch that has to forget most of them."""
    monkeypatch.setattr("strandline.operators.hot.LEAST_TRACKED", 128)
    near = spark.range(60_000).select(F.when(F.col("id") % 20 < 13, F.lit(-1) - F.col("id") % 20 % 3).otherwise(F.col("id")).alias("k"))
    sizes = {r["k"]: r["count"] for r in near.groupBy("k").count().collect()}
    hot = {r["__group"]["k"]: r["pieces"] for r in hot_groups(near, ["k"]).collect()}
    assert hot == {k: -(-n // 7500) for k, n in sizes.items() if n > 7500} and len(hot) == 3


def test_sketches_are_merged_by_sets_of_tasks(spark, split_groups, monkeypatch):
    """No task merges the sketches of all others, an empty table has none, and far more keys than are tracked lose no hot one."""
    from strandline.operators import hot

    monkeypatch.setattr(hot, "MERGED", 4)
    rows = spark.range(0, 40_000, 1, 32).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    total, found = hot.counted_groups(rows, ["k"])
    assert total == 40_000 and [(r["__group"]["k"], r["pieces"]) for r in found.collect()] == [(-1, 3)]
    sets = rows.select("k", F.floor(F.spark_partition_id() / hot.MERGED).alias("set")).groupBy("set").count()
    assert sets.count() == 8
    assert hot.counted_groups(rows.limit(0), ["k"]) == (0, None)


def test_hot_groups_just_under_many_others_are_not_cut_off(spark, split_groups, monkeypatch):
    """Counts too high by as much as the sketch allows may come before those of hot groups; all are counted exactly."""
    from strandline.operators import hot

    groups = {r["__group"]["k"] for r in hot_groups(spark.range(70_000).select((F.col("id") % 7).alias("k")), ["k"]).collect()}
    assert groups == set(range(7))
    monkeypatch.setattr(hot, "MOST_SHARES", 4)
    assert hot_groups(spark.range(70_000).select((F.col("id") % 7).alias("k")), ["k"]) is None


def test_null_times_are_peers(spark, split_groups):
    """As in a RANGE window, rows without a time are summed among themselves."""
    rows = spark.sql("SELECT id, id % 2 AS k, CASE WHEN id % 3 > 0 THEN timestamp_ntz'2024-01-01 00:00:00' END AS ts FROM range(600)")
    got = windows.moving_range_sums(rows, ["k"], "ts", "id", 60, {"n": F.lit(1).cast("bigint")})
    assert {(r["id"] % 3 > 0, r["n"]) for r in got.collect()} == {(True, 200), (False, 100)} and got.count() == 600


def test_numbers_in_order(spark):
    """Ties, nulls, NaN and rows that are all alike get each number once, in order."""
    values = [None, float("nan"), -1.5, 0.0, 2.0, 2.0] * 50 + [7.0] * 2000
    rows = spark.createDataFrame([(v, n % 3) for n, v in enumerate(values)], "v double, w int").repartition(7)
    found = sorted((r["place"], r["v"], r["w"]) for r in windows.numbered_in_order(rows, ["v", "w"], "place").collect())
    assert [p for p, _, _ in found] == list(range(1, len(values) + 1))

    def key(v):
        return (0, 0) if v is None else (2, 0) if v != v else (1, v)

    assert [(key(v), w) for _, v, w in found] == sorted((key(v), n % 3) for n, v in enumerate(values))
    alike = spark.range(3000).select(F.lit(1).alias("v")).repartition(5)
    assert sorted(r["place"] for r in windows.numbered_in_order(alike, ["v"], "place").collect()) == list(range(1, 3001))
    assert windows.numbered_in_order(rows.limit(0), ["v"], "place").collect() == []
