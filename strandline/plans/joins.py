"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.functions import exact_sum, from_units, units
from strandline.operators import joins
from strandline.plans.registry import query, sql_total, sql_units
from strandline.sources import table


def net_units():
    """Price after discount in units of 1e-4."""
    return units("l_extendedprice", 2) * (100 - units("l_discount", 2))


SQL_NET = f"{sql_units('l_extendedprice', 2)} * (100 - {sql_units('l_discount', 2)})"


@query(
    f"""SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS order_year,
        count(*) AS lines, {sql_total(SQL_NET, 4)} AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL"""
)
def join_four_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per nation and year.

    Lines are added up per order, orders per customer and year, and customers per nation and year before
    each join, so every join meets one row per key, and year, however many rows a key has.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    per_order = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"), exact_sum(net_units()).alias("net"))
    )
    per_customer = (
        per_order.join(orders, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "order_year")
        .agg(F.sum("lines").alias("lines"), F.sum("net").alias("net"))
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    per_nation = (
        per_customer.join(customers, "c_custkey")
        .groupBy("c_nationkey", "order_year")
        .agg(F.sum("lines").alias("lines"), F.sum("net").alias("net"))
    )
    return (
        per_nation.join(nations, "c_nationkey")
        .groupBy("n_name", "order_year")
        .agg(F.sum("lines").alias("lines"), from_units(F.sum("net"), 4).alias("revenue"))
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def inner_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with its order, dealing the lines of a hot order over many tasks."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    return joins.salted_join(line, orders, ["l_orderkey"]).drop("l_partkey")


@query(
    f"""SELECT o_orderkey, o_custkey, coalesce(max(n), 0) AS lines, max(quantity) AS quantity
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
    GROUP BY o_orderkey, o_custkey"""
)
def left_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with what their lines add up to. Orders without lines stay, with a null quantity."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", "o_custkey", F.coalesce("lines", F.lit(0)).alias("lines"), "quantity"
    )


@query(
    """SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS orders, coalesce(u, 0) AS urgent_orders
    FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u
        FROM orders GROUP BY o_custkey) RIGHT JOIN customer ON o_custkey = c_custkey"""
)
def right_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    counted = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent_orders"),
        )
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    none = {"orders": 0, "urgent_orders": 0}
    return counted.join(customers, "c_custkey", "right").na.fill(none)


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders
        WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey),
    b AS (SELECT o_custkey, count(*) AS n FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.n, 0) AS early,
        coalesce(b.n, 0) AS late
    FROM a FULL JOIN b ON a.o_custkey = b.o_custkey"""
)
def full_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer before a date and since. Some customers have only either."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    date, since = F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")
    early, late = orders.where(date < since), orders.where(date >= since)
    one = F.lit(1)
    return (
        early.groupBy("o_custkey")
        .agg(F.count(one).alias("early"))
        .join(late.groupBy("o_custkey").agg(F.count(one).alias("late")), "o_custkey", "full")
        .na.fill(0, ["early", "late"])
    )


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (
        SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""
)
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned line. Order keys are made distinct before the shuffle."""
    returned = (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("o_orderkey"))
        .distinct()
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(returned, "o_orderkey", "left_semi")


@query(
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(keys, "o_orderkey", "left_anti")


@query(
    """SELECT s.user_id, s.event_id AS error_id, p.event_id AS purchase_id,
        p.value AS purchase_value
    FROM events s JOIN events p ON s.user_id = p.user_id
        AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 2 HOURS
    WHERE s.event_type = 'error' AND p.event_type = 'purchase'"""
)
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases in the two hours after an error of the same user."""
    events = table(spark, sf, "events")
    errors = events.where(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts")
    )
    purchases = events.where(F.col("event_type") == "purchase").select(
        "user_id",
        F.col("event_id").alias("purchase_id"),
        F.col("value").alias("purchase_value"),
        F.col("ts").alias("purchase_ts"),
    )
    pairs = joins.range_join(errors, purchases, ["user_id"], "error_ts", "purchase_ts", 7200)
    return pairs.drop("error_ts", "purchase_ts")


@query(
    f"""SELECT p.user_id, p.event_id, count(c.event_id) AS clicks,
        coalesce(CAST(sum({sql_units('c.value', 2)}) AS BIGINT), 0) AS click_cents
    FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click'
        AND c.ts >= p.ts - INTERVAL 1 DAY AND c.ts <= p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.user_id, p.event_id"""
)
def interval_totals(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase, what the user clicked on in the day before, without forming the pairs."""
    events = table(spark, sf, "events")
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = events.where(F.col("event_type") == "click").select("user_id", "ts", "value")
    sums = {"clicks": F.lit(1).cast("bigint"), "click_cents": units("value", 2)}
    return joins.interval_totals(
        purchases, clicks, ["user_id"], "event_id", "ts", "ts", 86_400, sums
    )


@query(
    """SELECT p.event_id, p.user_id, p.ts, coalesce(c.click_id, -1) AS click_id, c.click_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, event_id AS click_id, value AS click_value FROM events
        WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's latest click before it; the click id is -1 where there is none."""
    events = table(spark, sf, "events")
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = events.where(F.col("event_type") == "click").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    joined = joins.asof_join(
        purchases, clicks, ["user_id"], ["ts", "event_id"], ["ts", "click_id"],
        ["click_id", "click_value"],
    )
    return joined.na.fill(-1, ["click_id"])


@query(
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer, LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)"""
)
def lateral_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest orders of each customer. Tasks drop all but three per customer on reading."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    largest = (
        orders.where(F.col("o_custkey") == F.col("c_custkey").outer())
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(3)
        .select("o_orderkey", "o_totalprice")
    )
    return customers.lateralJoin(largest)


@query(
    f"""SELECT l_partkey, count(*) AS small_lines,
        {sql_total(sql_units('l_extendedprice', 2), 2)} AS small_price
    FROM lineitem o WHERE l_quantity < (
        SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey)
    GROUP BY l_partkey"""
)
def correlated_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """Lines far below their part's mean quantity.

    Lines are first added up per part and quantity, so a part has a row per quantity it sold in. Its mean is
    taken over those rows by a window, which a part's lines do not enter, and lines are read once.
    """
    counted = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey", "l_quantity")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            exact_sum(units("l_extendedprice", 2)).alias("price"),
        )
    )
    part = Window.partitionBy("l_partkey")
    mean = F.sum(F.col("l_quantity") * F.col("lines")).over(part) / F.sum("lines").over(part)
    return (
        counted.withColumn("mean", mean)
        .where(F.col("l_quantity") < 0.2 * F.col("mean"))
        .groupBy("l_partkey")
        .agg(F.sum("lines").alias("small_lines"), from_units(F.sum("price"), 2).alias("small_price"))
    )
