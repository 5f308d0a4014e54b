"""Writing by folder and finding the shared folder."""

import pytest
from pyspark.sql import functions as F

from strandline.sources import scratch_path, write_partitioned
from strandline.sources.scratch import CHECKPOINT_DIR


def test_large_value_is_written_by_many_tasks(spark):
    """A value that holds nine tenths of the rows is not left to one task, and no row is lost."""
    key = F.when(F.pmod("id", F.lit(10)) == 0, F.lit(1)).otherwise(F.lit(2))
    noise = F.sha2(F.col("id").cast("string"), 256).alias("x")
    df = spark.range(400_000).select("id", key.alias("k"), noise)
    path = scratch_path(spark, "test-partitioned")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "2m")
    try:
        write_partitioned(df, path, "k")
    finally:
        spark.conf.unset(size)
    written = spark.read.parquet(path)
    named = written.select("k", F.input_file_name().alias("file")).distinct()
    files = named.groupBy("k").agg(F.count("file").alias("n")).collect()
    assert {r["k"] for r in files} == {1, 2}
    assert dict((r["k"], r["n"]) for r in files)[2] > 3
    assert written.agg(F.count("id"), F.sum("id")).first() == df.agg(F.count("id"), F.sum("id")).first()


def test_folder_pruning(spark):
    path = scratch_path(spark, "test-pruning")
    write_partitioned(spark.range(100).withColumn("k", F.col("id") % 5), path, "k")
    plan = spark.read.parquet(path).where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_scratch_path_is_in_the_named_folder(spark):
    named = spark.conf.get(CHECKPOINT_DIR, None)
    paths = {scratch_path(spark, "a") for _ in range(3)}
    assert len(paths) == 3
    if named:
        assert all(p.startswith(named.rstrip("/") + "/") for p in paths)


def test_scratch_path_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return "spark://somewhere:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch_path(Session(), "a")
