"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import from_units, units
from strandline.operators import windows
from strandline.plans.registry import query, sql_units
from strandline.sources import table


@query(
    """SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth
    FROM orders"""
)
def row_number(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    numbered = windows.row_numbers(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "nth")
    return numbered.drop("o_orderdate")


@query(
    """SELECT o_custkey, o_orderkey, CAST(ntile(4) OVER (
        PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quarter
    FROM orders"""
)
def ntile(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    tiled = windows.tiles(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"], 4, "quarter")
    return tiled.drop("o_totalprice")


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderdate,
        rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)"""
)
def rank_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Rank orders by date within their state: few large groups and many ties."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    ranked = windows.peer_ranks(orders, ["o_orderstatus"], "o_orderdate")
    return ranked.drop("percent_rank", "cume_dist")


@query(
    """SELECT p_partkey, p_brand, round(percent_rank() OVER w, 9) AS percent_rank,
        round(cume_dist() OVER w, 9) AS cume_dist
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)"""
)
def relative_rank(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    ranked = windows.peer_ranks(part, ["p_brand"], "p_retailprice")
    return ranked.select(
        "p_partkey",
        "p_brand",
        F.round("percent_rank", 9).alias("percent_rank"),
        F.round("cume_dist", 9).alias("cume_dist"),
    )


@query(
    """SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS before_price,
        lead(o_totalprice) OVER w AS after_price, first_value(o_orderpriority) OVER w AS first_priority
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def lag_lead_first(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    found = windows.neighbours(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        lags={"before_price": "o_totalprice"},
        leads={"after_price": "o_totalprice"},
        firsts={"first_priority": "o_orderpriority"},
    )
    return found.drop("o_orderdate", "o_totalprice", "o_orderpriority")


@query(
    f"""SELECT event_id, user_id,
        CAST(sum({sql_units('value', 2)}) OVER w AS DOUBLE) / 100.0 AS sum_value,
        count(*) OVER w AS n, max(value) OVER w AS max_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def moving_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of each event and the nine before it of the same user."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    aggs = {
        "cents": F.sum(units("value", 2)),
        "n": F.count(F.lit(1)),
        "max_value": F.max("value"),
    }
    moved = windows.moving_rows(events, ["user_id"], ["ts", "event_id"], 9, aggs)
    return moved.select(
        "event_id", "user_id", from_units("cents", 2).alias("sum_value"), "n", "max_value"
    )


@query(
    f"""SELECT event_id, user_id,
        CAST(sum({sql_units('value', 2)}) OVER w AS DOUBLE) / 100.0 AS sum_value, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts
        RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"""
)
def moving_range(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of each user's last day up to each event."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    sums = {"cents": units("value", 2), "n": F.lit(1).cast("bigint")}
    moved = windows.moving_range_sums(events, ["user_id"], "ts", "event_id", 86_400, sums)
    return moved.select("event_id", "user_id", from_units("cents", 2).alias("sum_value"), "n")
