"""User-defined scalar, aggregate, grouped and table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import udfs
from strandline.plans.registry import query
from strandline.sources import table


@query("SELECT p_partkey, p_retailprice / p_size AS price_per_size FROM part")
def scalar_udf(spark: SparkSession, sf: str) -> DataFrame:
    price = udfs.price_per_size("p_retailprice", "p_size").alias("price_per_size")
    return table(spark, sf, "part").select("p_partkey", price)


@query(
    """SELECT o_orderpriority, round(regr_slope(o_totalprice,
        date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)), 5) AS slope, count(*) AS n
    FROM orders GROUP BY o_orderpriority"""
)
def grouped_map_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Price trend per priority. Each task adds up its own rows, so a group has a row a task when its line is fitted."""
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    orders = table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderkey", days.alias("x"), F.col("o_totalprice").alias("y")
    )

    def line(parts: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, sxy = (parts[c].sum() for c in ("n", "sx", "sy", "sxx", "sxy"))
        priority = parts["o_orderpriority"].iloc[0]
        return pd.DataFrame([{"o_orderpriority": priority, "slope": (n * sxy - sx * sy) / (n * sxx - sx * sx), "n": n}])

    added = udfs.per_task("o_orderpriority", udfs.moments)
    parts = orders.mapInPandas(added, f"o_orderpriority string, {udfs.MOMENTS}")
    fitted = parts.groupBy("o_orderpriority").applyInPandas(line, "o_orderpriority string, slope double, n long")
    return fitted.withColumn("slope", F.round("slope", 5))


@query(
    """SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean
    FROM lineitem GROUP BY l_returnflag"""
)
def aggregate_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric mean. Each task adds up its own logarithms; the user aggregate weighs the tasks' sums."""
    line = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")

    def logs(rows: pd.DataFrame) -> dict[str, float]:
        return {"total": np.log(rows["l_extendedprice"]).sum(), "n": len(rows)}

    parts = line.mapInPandas(udfs.per_task("l_returnflag", logs), "l_returnflag string, total double, n long")
    means = parts.groupBy("l_returnflag").agg(udfs.weighted_mean("total", "n").alias("mean"))
    return means.select("l_returnflag", F.round(F.exp("mean"), 4).alias("geometric_mean"))


@query(
    """SELECT doc_id, CAST(generate_subscripts(w, 1) AS INTEGER) AS line_number, unnest(w) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)"""
)
def table_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as one row per line."""
    return udfs.Lines(table(spark, sf, "documents").select("doc_id", "text").asTable())
