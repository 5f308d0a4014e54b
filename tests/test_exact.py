"""Exact sums at the edges of what a bigint holds."""

from pyspark.sql import functions as F

from strandline.functions import exact_sum, from_units, units


def test_sum_beyond_bigint_and_below_zero(spark):
    values = [2**62, 2**62, 2**62, -5, -(2**40) - 3, 7, None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    total = df.agg(exact_sum("v").alias("t")).first()["t"]
    assert int(total) == sum(v for v in values if v is not None)


def test_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v bigint")
    assert df.agg(exact_sum("v").alias("t")).first()["t"] is None


def test_units_of_every_cent(spark):
    cents = spark.range(-200_000, 200_000).select("id", (F.col("id") / 100).alias("x"))
    assert cents.where(units("x", 2) != F.col("id")).count() == 0
    assert cents.where(from_units("id", 2) != F.col("x")).count() == 0
