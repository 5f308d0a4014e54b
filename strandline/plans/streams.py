"""Streaming queries over the event table, run over its file to the end.

In append mode a window comes out once the watermark has passed its end, so the last windows stay in
state. The SQL twins leave the same windows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import exact_sum, from_units, units
from strandline.plans.registry import query, sql_total
from strandline.plans.timewindows import SQL_CENTS, SQL_SESSIONS
from strandline.sources import scratch_path, table
from strandline.streaming import operators
from strandline.streaming.runs import run_to_files, stream_folder, stream_table


def _value_columns():
    return {
        "n": F.count(F.lit(1)),
        "value": from_units(exact_sum(units("value", 2)), 2),
    }


@query(
    f"""SELECT event_type, start, start + INTERVAL 1 DAY AS "end", n, value
    FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n,
        {sql_total(SQL_CENTS, 2)} AS value FROM events GROUP BY event_type, start)
    WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"""
)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    events = stream_table(spark, sf, "events").select("ts", "event_type", "value")
    timed = operators.event_time(events, "ts", "10 minutes")
    days = operators.windowed(timed, F.window("ts", "1 day"), ["event_type"], _value_columns())
    return run_to_files(days, scratch_path(spark, "stream-tumbling"))


@query(
    f"""SELECT event_type, count(*) AS n, {sql_total(SQL_CENTS, 2)} AS value
    FROM events GROUP BY event_type"""
)
def stream_running(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per event type since the start: the stream writes sums of its batches, and the report adds them up."""
    events = stream_table(spark, sf, "events").select("event_type", units("value", 2).alias("cents"))
    sums = operators.partial_sums(events, ["event_type"], {"n": F.lit(1), "cents": F.col("cents")})
    parts = run_to_files(sums, scratch_path(spark, "stream-running"))
    totals = parts.groupBy("event_type").agg(F.sum("n").alias("n"), exact_sum("cents").alias("cents"))
    return totals.select("event_type", "n", from_units("cents", 2).alias("value"))


@query(
    f"""SELECT * FROM ({SQL_SESSIONS})
    WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user that end with four hours of silence, once they are closed."""
    events = stream_table(spark, sf, "events").select("ts", "user_id", "value")
    timed = operators.event_time(events, "ts", "10 minutes")
    session = F.session_window("ts", "4 hours")
    sessions = operators.windowed(timed, session, ["user_id"], _value_columns())
    return run_to_files(sessions, scratch_path(spark, "stream-sessions"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_deduplication(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice, let through once."""
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    once = stream_table(spark, sf, "events").select(*columns)
    again = stream_table(spark, sf, "events").select(*columns)
    timed = operators.event_time(once.unionAll(again), "ts", "1 hour")
    single = timed.dropDuplicatesWithinWatermark(["event_id"])
    single = single.withColumn("ts", operators.unzoned("ts"))
    return run_to_files(single, scratch_path(spark, "stream-deduplication"))


@query(
    """SELECT s.user_id, s.event_id AS error_id, p.event_id AS purchase_id,
        p.value AS purchase_value
    FROM events s JOIN events p ON s.user_id = p.user_id
        AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 2 HOURS
    WHERE s.event_type = 'error' AND p.event_type = 'purchase'"""
)
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases in the two hours after an error of the same user."""
    events = stream_table(spark, sf, "events")
    errors = events.where(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts")
    )
    purchases = events.where(F.col("event_type") == "purchase").select(
        "user_id",
        F.col("event_id").alias("purchase_id"),
        F.col("value").alias("purchase_value"),
        F.col("ts").alias("purchase_ts"),
    )
    pairs = operators.interval_join(
        operators.event_time(errors, "error_ts", "10 minutes"),
        operators.event_time(purchases, "purchase_ts", "10 minutes"),
        ["user_id"],
        "error_ts",
        "purchase_ts",
        7200,
    )
    found = pairs.select("l.user_id", "error_id", "purchase_id", "purchase_value")
    return run_to_files(found, scratch_path(spark, "stream-interval-join"))


@query(
    f"""WITH mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS first_mark FROM events
        WHERE event_type <> 'error'),
    kept AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end
        FROM events, mark WHERE event_type <> 'error'
            OR time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY > first_mark)
    SELECT event_type, window_end - INTERVAL 1 DAY AS start, window_end AS "end", count(*) AS n,
        {sql_total(SQL_CENTS, 2)} AS value
    FROM kept GROUP BY event_type, window_end
    HAVING window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Errors arrive after everything else, in a second run of the stream. Those whose window the
    watermark has closed are dropped; the rest are counted."""
    events = table(spark, sf, "events").select("ts", "event_type", "value")
    folder = scratch_path(spark, "stream-late-rows")
    arrivals = f"{folder}/arrivals"
    is_error = F.col("event_type") == "error"

    def run() -> DataFrame:
        timed = operators.event_time(stream_folder(spark, arrivals, events.schema), "ts", "1 hour")
        days = operators.windowed(timed, F.window("ts", "1 day"), ["event_type"], _value_columns())
        return run_to_files(days, folder)

    events.where(~is_error).write.parquet(arrivals)
    run()
    events.where(is_error).write.mode("append").parquet(arrivals)
    return run()


@query(
    f"""WITH line AS (
        SELECT user_id, event_id, ts, value, event_type = 'error' AS broken,
            lag(event_type = 'error') OVER w AS after_broken, lag(ts) OVER w AS before
        FROM events WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(CASE WHEN after_broken IS NULL OR after_broken OR ts - before > INTERVAL 12 HOURS THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak
        FROM line WHERE NOT broken
    ), ended AS (
        SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, {sql_total(SQL_CENTS, 2)} AS value
        FROM numbered GROUP BY user_id, streak
    )
    SELECT user_id, start, e."end", n, value FROM ended e
    WHERE EXISTS (SELECT 1 FROM line l WHERE l.user_id = e.user_id AND l.ts > e."end")
        OR e."end" + INTERVAL 12 HOURS < (SELECT max(ts) - INTERVAL 10 MINUTES FROM line)"""
)
def stream_keyed_state(spark: SparkSession, sf: str) -> DataFrame:
    """A user's purchases in a row, without an error between them or twelve hours of waiting, in state of our own.

    A streak comes out once it has ended; those still open at the end of the stream stay in state.
    """
    events = stream_table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    events = events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("broken"), units("value", 2).alias("cents"))
    timed = operators.event_time(events, "ts", "10 minutes")
    found = run_to_files(operators.streaks(timed, "user_id", "ts", "event_id", 12 * 3600), scratch_path(spark, "stream-keyed-state"))
    at = lambda c: operators.unzoned(F.timestamp_micros(c))
    return found.select("user_id", at("first_us").alias("start"), at("last_us").alias("end"), "n", from_units("cents", 2).alias("value"))
