"""Scans, filters, projections, sorts, set operations, duplicates and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import units
from strandline.operators import sets
from strandline.operators.joins import best_per_key
from strandline.operators.recursion import recurse
from strandline.operators.windows import numbered_in_order
from strandline.plans.registry import query, sql_units
from strandline.sources import scratch_path, table, write_partitioned


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Column pruning: three of eleven columns are read."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@query(
    """SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS order_year
    FROM orders WHERE year(o_orderdate) IN (1996, 1999)"""
)
def partitioned_write(spark: SparkSession, sf: str) -> DataFrame:
    """Write orders by year, then read two years back: the other folders are not listed for reading."""
    orders = table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    path = scratch_path(spark, "orders-by-year")
    write_partitioned(orders, path, "order_year")
    years = spark.read.parquet(path).where(F.col("order_year").isin(1996, 1999))
    return years.select("o_orderkey", "o_orderpriority", "order_year")


@query(
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
      AND l_returnflag IN ('A', 'R') AND l_linestatus IS NOT NULL"""
)
def filter_ranges(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    year = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (
        F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    )
    return line.where(
        year
        & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)
        & F.col("l_returnflag").isin("A", "R")
        & F.col("l_linestatus").isNotNull()
    ).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query(
    """SELECT p_partkey, p_name, p_brand FROM part
    WHERE p_name LIKE '%a%' AND p_brand NOT LIKE 'Brand#1_' AND NOT (p_size > 40 OR p_size < 5)"""
)
def filter_patterns(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.where(
        F.col("p_name").like("%a%")
        & ~F.col("p_brand").like("Brand#1_")
        & ~((F.col("p_size") > 40) | (F.col("p_size") < 5))
    ).select("p_partkey", "p_name", "p_brand")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_suppkey,
        {sql_units('l_extendedprice', 2)} * (100 - {sql_units('l_discount', 2)}) AS net_units,
        CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'usual' ELSE 'small' END
            AS size_class,
        coalesce(nullif(l_returnflag, 'N'), 'none') AS return_class
    FROM lineitem"""
)
def computed_projection(spark: SparkSession, sf: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        (units("l_extendedprice", 2) * (100 - units("l_discount", 2))).alias("net_units"),
        F.when(quantity >= 40, "bulk")
        .when(quantity >= 10, "usual")
        .otherwise("small")
        .alias("size_class"),
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")).alias("return_class"),
    )


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Each task keeps its best hundred, so no full sort is done."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    """SELECT o_orderkey, o_orderdate,
        row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders"""
)
def total_order(spark: SparkSession, sf: str) -> DataFrame:
    """Number the whole table in order, cut along the order so that no task sorts everything."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return numbered_in_order(orders, ["o_orderdate", "o_orderkey"], "place")


def _busy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers of urgent orders and of finished orders, one row per order."""
    orders = table(spark, sf, "orders")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    finished = orders.where(F.col("o_orderstatus") == "F").select("o_custkey")
    return urgent, finished


_URGENT = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
_FINISHED = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"


@query(f"{_URGENT} UNION {_FINISHED}")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return sets.union(*_busy(spark, sf))


@query(f"{_URGENT} UNION ALL {_FINISHED}")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    urgent, finished = _busy(spark, sf)
    return urgent.unionAll(finished)


@query(f"{_URGENT} INTERSECT {_FINISHED}")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return sets.intersect(*_busy(spark, sf))


@query(f"{_URGENT} INTERSECT ALL {_FINISHED}")
def set_intersect_all(spark: SparkSession, sf: str) -> DataFrame:
    return sets.intersect_all(*_busy(spark, sf))


@query(f"{_URGENT} EXCEPT {_FINISHED}")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return sets.subtract(*_busy(spark, sf))


@query(f"{_URGENT} EXCEPT ALL {_FINISHED}")
def set_except_all(spark: SparkSession, sf: str) -> DataFrame:
    return sets.subtract_all(*_busy(spark, sf))


@query(
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n
        FROM lineitem) WHERE n = 1"""
)
def drop_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order and line number, the latest shipped. Which row stays is not left to chance."""
    line = table(spark, sf, "lineitem")
    by = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return best_per_key(line, ["l_orderkey", "l_linenumber"], [F.col(c) for c in by], by)


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return table(spark, sf, "orders").select(*columns).dropDuplicates()


@query(
    """WITH RECURSIVE talk AS (
        SELECT conv_id, turn, role AS roles, CAST(length(text) AS BIGINT) AS chars
        FROM conversations WHERE turn = 0
        UNION ALL
        SELECT c.conv_id, c.turn, t.roles || '>' || c.role, t.chars + length(c.text)
        FROM talk t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
    SELECT conv_id, turn, roles, chars FROM talk"""
)
def recursive_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Follow each conversation turn by turn. Each round joins on conversation and turn.

    Texts are read once, for their lengths; the rounds join the narrow table of those.
    """
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("n")
    )
    folder = scratch_path(spark, "turns")
    turns.write.parquet(folder)
    turns = spark.read.schema(turns.schema).parquet(folder)
    start = turns.where("turn = 0").select(
        "conv_id", "turn", F.col("role").alias("roles"), F.col("n").alias("chars")
    )

    def following(reached: DataFrame) -> DataFrame:
        asked = reached.withColumn("turn", F.col("turn") + 1)
        return asked.join(turns, ["conv_id", "turn"]).select(
            "conv_id",
            "turn",
            F.concat("roles", F.lit(">"), "role").alias("roles"),
            (F.col("chars") + F.col("n")).alias("chars"),
        )

    return recurse(start, following)
