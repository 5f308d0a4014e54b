"""Running a stream over the files at hand and reading back what it wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


STREAM_SETTINGS = {
    # State on local disk with changes kept in the checkpoint, so it may outgrow executor memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Sessions of a task are merged before the shuffle, so a hot key sends sessions and not rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def stream_settings(spark: SparkSession):
    """Settings a stream takes over when it starts, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory as a stream of files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(directory)


def stream_folder(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """The files of a folder as a stream, oldest first.

    ``files_per_batch`` bounds what a batch takes in and what a failure repeats. Rows in a later
    batch may then be late, so it suits folders whose files arrive about in time order.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Take in all files at hand, then read what the stream has written so far.

    Output and progress are kept under ``folder``. A second run with the same folder goes on where
    the first one ended, as does a run after a failure.
    """
    spark = stream.sparkSession
    with stream_settings(spark):
        run = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", f"{folder}/progress")
            .option("path", f"{folder}/rows")
            .trigger(availableNow=True)
            .start()
        )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
