"""Streams over several files and runs."""

import datetime
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.sources import scratch_path, table
from strandline.streaming import operators
from strandline.streaming.runs import STREAM_SETTINGS, run_to_files, stream_folder
from tests.compare import TESTDATA

SF_DIR = os.path.join(TESTDATA, "sf0.001")


@pytest.fixture(scope="module")
def arrivals(spark):
    """The events in four files, written one after another in time order, and their folder."""
    events = table(spark, SF_DIR, "events")
    folder = scratch_path(spark, "test-arrivals")
    start = datetime.datetime(2024, 1, 1)
    for week in range(5):
        low, high = (F.lit(start + datetime.timedelta(days=7 * w)) for w in (week, week + 1))
        part = events.where((F.col("ts") >= low) & (F.col("ts") < high))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, folder):
    schema = table(spark, SF_DIR, "events").schema
    return stream_folder(spark, folder, schema, files_per_batch=1)


def test_windows_over_many_batches(spark, arrivals):
    timed = operators.event_time(_stream(spark, arrivals), "ts", "10 minutes")
    aggs = {"n": F.count(F.lit(1))}
    days = operators.windowed(timed, F.window("ts", "1 day"), ["event_type"], aggs)
    got = run_to_files(days, scratch_path(spark, "test-windows"))
    events = table(spark, SF_DIR, "events")
    expected = events.groupBy("event_type", F.date_trunc("day", "ts").alias("start")).count()
    last = events.agg(F.max("ts")).first()[0].date()
    found = {(r["event_type"], r["start"].date()): r["n"] for r in got.collect()}
    closed = {
        (r["event_type"], r["start"].date()): r["count"]
        for r in expected.collect()
        if r["start"].date() < last
    }
    assert found == closed


def test_sums_go_on_after_a_restart(spark):
    """Progress is found again by a second run, and no file is counted twice."""
    events = table(spark, SF_DIR, "events").select("user_id", "event_id")
    folder = scratch_path(spark, "test-restart")
    arriving = f"{folder}/arrivals"
    totals = []
    for _ in range(2):
        events.write.mode("append").parquet(arriving)
        sums = operators.partial_sums(stream_folder(spark, arriving, events.schema), ["user_id"], {"n": F.lit(1)})
        written = run_to_files(sums, folder)
        totals.append(written.agg(F.sum("n")).first()[0])
        assert written.count() < 2 * events.count()
    assert totals == [events.count(), 2 * events.count()]


def _streaks(spark, folder, arriving, schema):
    timed = operators.event_time(stream_folder(spark, arriving, schema), "ts", "10 minutes")
    found = run_to_files(operators.streaks(timed, "k", "ts", "id", 3600), folder)
    return sorted((r["k"], r["n"], r["cents"]) for r in found.collect())


def test_state_outlives_a_restart_and_silence_ends_it(spark):
    folder = scratch_path(spark, "test-state")
    arriving = f"{folder}/arrivals"
    day = datetime.datetime(2024, 1, 1)

    def arrive(*rows):
        data = [(i, k, day + datetime.timedelta(minutes=m), broken, 1 << i) for i, k, m, broken in rows]
        df = spark.createDataFrame(data, "id long, k string, ts timestamp_ntz, broken boolean, cents long")
        df.coalesce(1).write.mode("append").parquet(arriving)
        return _streaks(spark, folder, arriving, df.schema)

    # Out of order within a batch; b is broken at once, a goes on in the next run, c falls silent.
    assert arrive((2, "a", 20, False), (1, "a", 10, False), (3, "b", 0, True), (4, "c", 5, False)) == []
    assert arrive((5, "a", 40, False), (6, "b", 41, False), (7, "b", 42, True)) == [("b", 1, 1 << 6)]
    found = arrive((8, "a", 100 + 45, False))
    assert ("a", 3, (1 << 1) + (1 << 2) + (1 << 5)) in found and ("c", 1, 1 << 4) in found
    assert len(found) == 3


def test_streaks_of_whole_batches_are_those_of_single_rows():
    """Rows are handed over in batches of any size, with gaps, breaks, rows that come late and ties."""
    rng = np.random.default_rng(3)
    for trial in range(300):
        rows = rng.integers(1, 40)
        us = np.cumsum(rng.integers(-2, 12, rows))
        broken, cents = rng.random(rows) < rng.choice([0, 0.2, 0.9]), rng.integers(-50, 50, rows)
        ended, open_ = [], None
        for u, b, c in zip(us.tolist(), broken.tolist(), cents.tolist()):
            if open_ is not None and (b or u - open_[1] > 8):
                ended.append(open_)
                open_ = None
            if not b:
                open_ = (u, u, 1, c) if open_ is None else (open_[0], u, open_[2] + 1, open_[3] + c)
        found, state, at = [], None, 0
        while at < rows:
            to = at + int(rng.integers(1, 15))
            some, state = operators.ended_streaks(state, us[at:to], broken[at:to], cents[at:to], 8)
            found += some
            at = to
        assert (found, state) == (ended, open_)


def test_sums_that_might_wrap_are_an_error():
    one = np.array([1]), np.array([False])
    for state, cents in [(None, [2**62, 2**62]), ((0, 0, 1, 2**63 - 2), [2**40])]:
        k = len(cents)
        with pytest.raises(OverflowError):
            operators.ended_streaks(state, np.repeat(one[0], k), np.repeat(one[1], k), np.array(cents), 8)
    operators.fits_bigint(pa.array([], pa.int64()))
    operators.fits_bigint(pa.array([None, 2**61], pa.int64()))
    with pytest.raises(OverflowError):
        operators.fits_bigint(pa.array([-(2**62), 0], pa.int64()))


def test_copies_in_a_later_batch_are_dropped(spark):
    """The copies come in files of their own, so what was let through is found in state."""
    events = table(spark, SF_DIR, "events").select("event_id", "ts").where("event_id < 200")
    folder = scratch_path(spark, "test-copies")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    stream = stream_folder(spark, f"{folder}/arrivals", events.schema, files_per_batch=1)
    single = operators.event_time(stream, "ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    assert run_to_files(single, folder).count() == events.count()


def test_settings_are_put_back(spark, arrivals):
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    run_to_files(_stream(spark, arrivals).select("event_id"), scratch_path(spark, "test-settings"))
    assert {key: spark.conf.get(key, None) for key in STREAM_SETTINGS} == before


def test_times_keep_their_wall_clock_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # A time New York skips, one it has twice, and the two instants of that one.
        texts = [
            "2024-03-10 02:30:00",
            "2024-11-03 01:30:00",
            "2024-11-03 05:30:00.000001",
            "2024-11-03 06:30:00",
        ]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        ntz = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
        same = ntz.select("t", operators.unzoned(operators.zoned("t")).alias("u"))
        assert [r["u"] for r in same.collect()] == [r["t"] for r in same.collect()]
        micros = ntz.select(F.unix_micros(operators.zoned("t")).alias("m")).collect()
        utc = datetime.timezone.utc
        wanted = [datetime.datetime.fromisoformat(t).replace(tzinfo=utc) for t in texts]
        assert [r["m"] for r in micros] == [
            int(w.timestamp()) * 1_000_000 + w.microsecond for w in wanted
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
