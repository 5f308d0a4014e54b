"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import exact_sum, from_units, units
from strandline.operators.aggregates import exact_percentile
from strandline.plans.joins import SQL_NET, net_units
from strandline.plans.registry import query, sql_total, sql_units
from strandline.sources import table

_PRICE = sql_units("l_extendedprice", 2)
_CHARGE = f"{SQL_NET} * (100 + {sql_units('l_tax', 2)})"
_ORDER_CENTS = sql_units("o_totalprice", 2)


@query(
    f"""SELECT l_returnflag, l_linestatus, {sql_total('CAST(l_quantity AS BIGINT)', 0)} AS sum_qty,
        {sql_total(_PRICE, 2)} AS sum_base_price, {sql_total(SQL_NET, 4)} AS sum_disc_price,
        {sql_total(_CHARGE, 6)} AS sum_charge,
        {sql_total('CAST(l_quantity AS BIGINT)', 0)} / count(*) AS avg_qty,
        {sql_total(_PRICE, 2)} / count(*) AS avg_price,
        min(l_discount) AS min_disc, max(l_discount) AS max_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01'
    GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per return flag and line status. One small row per task and group is shuffled."""
    charge = net_units() * (100 + units("l_tax", 2))
    shipped = F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz")
    n = F.count(F.lit(1))
    quantity = from_units(exact_sum(F.col("l_quantity").cast("bigint")), 0)
    price = from_units(exact_sum(units("l_extendedprice", 2)), 2)
    return (
        table(spark, sf, "lineitem")
        .where(shipped)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            quantity.alias("sum_qty"),
            price.alias("sum_base_price"),
            from_units(exact_sum(net_units()), 4).alias("sum_disc_price"),
            from_units(exact_sum(charge), 6).alias("sum_charge"),
            (quantity / n).alias("avg_qty"),
            (price / n).alias("avg_price"),
            F.min("l_discount").alias("min_disc"),
            F.max("l_discount").alias("max_disc"),
            n.alias("count_order"),
        )
    )


@query(
    f"""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS orders,
        count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
        CAST(coalesce(sum({_ORDER_CENTS}) FILTER (WHERE o_totalprice > 400000), 0) AS DOUBLE) / 100.0
            AS large_price
    FROM orders GROUP BY o_orderpriority"""
)
def distinct_and_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct customers and conditional totals per priority.

    Orders are first added up per priority and customer, so the distinct count needs no second
    copy of the rows.
    """
    one = F.lit(1)
    large = F.when(F.col("o_totalprice") > 400_000, units("o_totalprice", 2))
    per_customer = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", "o_custkey")
        .agg(
            F.count(one).alias("orders"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            exact_sum(large).alias("large_price"),
        )
    )
    return per_customer.groupBy("o_orderpriority").agg(
        F.count("o_custkey").alias("customers"),
        F.sum("orders").alias("orders"),
        F.sum("finished").alias("finished"),
        F.coalesce(from_units(F.sum("large_price"), 2), F.lit(0.0)).alias("large_price"),
    )


def _balances(spark: SparkSession, sf: str) -> DataFrame:
    """Customers added up per region, nation and segment: at most one row per combination.

    Subtotals are taken from these sums, so the copies that rollup and cube make are of few rows.
    """
    per_nation = (
        table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(units("c_acctbal", 2)).alias("cents"))
    )
    nations = table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")
    )
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    return per_nation.join(nations, "n_nationkey").join(regions, "r_regionkey")


_BALANCES = f"""count(*) AS customers, {sql_total(sql_units('c_acctbal', 2), 2)} AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _balance_columns():
    return [F.sum("n").alias("customers"), from_units(F.sum("cents"), 2).alias("balance")]


@query(
    f"""SELECT r_name, n_name, c_mktsegment,
        CAST(grouping_id(r_name, n_name, c_mktsegment) AS BIGINT) AS level, {_BALANCES}
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)"""
)
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = _balances(spark, sf).rollup("r_name", "n_name", "c_mktsegment")
    return rolled.agg(F.grouping_id().alias("level"), *_balance_columns())


@query(
    f"""SELECT r_name, c_mktsegment, CAST(grouping(r_name) AS INTEGER) AS all_regions,
        CAST(grouping(c_mktsegment) AS INTEGER) AS all_segments, {_BALANCES}
    GROUP BY CUBE (r_name, c_mktsegment)"""
)
def cube(spark: SparkSession, sf: str) -> DataFrame:
    cubed = _balances(spark, sf).cube("r_name", "c_mktsegment")
    return cubed.agg(
        F.grouping("r_name").cast("int").alias("all_regions"),
        F.grouping("c_mktsegment").cast("int").alias("all_segments"),
        *_balance_columns(),
    )


@query(
    f"""SELECT o_orderstatus, o_orderpriority, count(*) AS orders,
        {sql_total(_ORDER_CENTS, 2)} AS price
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"""
)
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    counted = (
        table(spark, sf, "orders")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), exact_sum(units("o_totalprice", 2)).alias("cents"))
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return counted.groupingSets([[status, priority], [priority], []], status, priority).agg(
        F.sum("n").alias("orders"), from_units(F.sum("cents"), 2).alias("price")
    )


@query(
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
        round(covar_samp(l_quantity, l_extendedprice), 3) AS covariance,
        round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
        round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
        round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
        round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_discount), 8) AS variance
    FROM lineitem GROUP BY l_returnflag"""
)
def regression(spark: SparkSession, sf: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.round(F.corr(x, y), 6).alias("correlation"),
            F.round(F.covar_samp(x, y), 3).alias("covariance"),
            F.round(F.regr_slope(y, x), 4).alias("slope"),
            F.round(F.regr_intercept(y, x), 2).alias("intercept"),
            F.round(F.regr_r2(y, x), 6).alias("r2"),
            F.round(F.stddev_samp(x), 6).alias("deviation"),
            F.round(F.var_pop("l_discount"), 8).alias("variance"),
        )
    )


@query(
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
        round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
        round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
    FROM lineitem GROUP BY l_returnflag"""
)
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    shares = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    line = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_percentile(line, ["l_returnflag"], "l_extendedprice", shares)
    return found.select("l_returnflag", *(F.round(n, 4).alias(n) for n in shares))


@query(
    """SELECT l_returnflag, count(*) AS lines, TRUE AS parts_close, TRUE AS median_close
    FROM lineitem GROUP BY l_returnflag"""
)
def approximate_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of fixed size per group, and whether they keep to their errors.

    Engines' sketches differ by design, so the query measures them: the count of distinct parts may be off by
    five standard errors, and the share of lines priced at most the median by the inverse of the
    accuracy. The exact figures are counts of rows made distinct, or added up per task, first.
    """
    error, accuracy = 0.02, 10_000
    line = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    sketches = line.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", rsd=error).alias("parts"),
        F.percentile_approx("l_extendedprice", 0.5, accuracy).alias("median"),
    )
    exact = line.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"))
    # One row a flag, so each of these joins has a side that small.
    placed = line.join(sketches, "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_extendedprice") < F.col("median")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("median")).alias("upto"),
        F.first("parts").alias("parts"),
    )
    slack = F.col("lines") / accuracy + 1
    middle = F.col("lines") / 2
    return placed.join(exact, "l_returnflag").select(
        "l_returnflag",
        "lines",
        (F.abs(F.col("parts") - F.col("exact")) <= 5 * error * F.col("exact")).alias("parts_close"),
        ((F.col("below") <= middle + slack) & (F.col("upto") >= middle - slack)).alias("median_close"),
    )


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest_order,
        arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS smallest_order,
        arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS latest_priority
    FROM orders GROUP BY o_custkey"""
)
def arg_min_max(spark: SparkSession, sf: str) -> DataFrame:
    """The order key breaks ties, so the answer does not depend on the partitioning."""
    by_price, by_date = F.struct("o_totalprice", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            F.max_by("o_orderkey", by_price).alias("largest_order"),
            F.min_by("o_orderkey", by_price).alias("smallest_order"),
            F.max_by("o_orderpriority", by_date).alias("latest_priority"),
        )
    )


# The order states of the orders table.
ORDER_STATES = ["F", "O", "P"]


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
        count(*) FILTER (WHERE o_orderstatus = 'P') AS P,
        count(*) FILTER (WHERE coalesce(o_orderstatus, '') NOT IN ('F', 'O', 'P')) AS other
    FROM orders GROUP BY o_orderpriority"""
)
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The states are named, so Spark need not look for them in a pass of its own. Any other, and none, count as other."""
    state = F.when(F.col("o_orderstatus").isin(ORDER_STATES), F.col("o_orderstatus")).otherwise("other")
    orders = table(spark, sf, "orders").select("o_orderpriority", state.alias("state"))
    pivoted = orders.groupBy("o_orderpriority").pivot("state", [*ORDER_STATES, "other"])
    return pivoted.agg(F.count(F.lit(1))).na.fill(0)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM lineitem
    UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))"""
)
def unpivot(spark: SparkSession, sf: str) -> DataFrame:
    ids, values = ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"]
    line = table(spark, sf, "lineitem").select(*ids, *values)
    return line.unpivot(ids, values, "measure", "amount")
