"""Event-time windows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import exact_sum, from_units, units
from strandline.operators import timewindows
from strandline.plans.registry import query, sql_total, sql_units
from strandline.sources import table

SQL_CENTS = sql_units("value", 2)


@query(
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts)
        + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, {sql_total(SQL_CENTS, 2)} AS value
    FROM events GROUP BY ALL"""
)
def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    aggs = [F.count(F.lit(1)).alias("n"), from_units(exact_sum(units("value", 2)), 2).alias("value")]
    return timewindows.tumbling(events, "ts", "1 day", ["event_type"], aggs)


@query(
    f"""WITH hops AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS start
        FROM events, range(4) AS r(k))
    SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n,
        {sql_total(SQL_CENTS, 2)} AS value
    FROM hops GROUP BY start, event_type"""
)
def sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    """Day-long windows every six hours, from six-hour sums."""
    events = table(spark, sf, "events").select("ts", "event_type", "value")
    sums = {"n": F.lit(1).cast("bigint"), "cents": units("value", 2)}
    windows = timewindows.sliding_sums(events, "ts", "1 day", "6 hours", ["event_type"], sums)
    return windows.select(
        "start", "end", "event_type", "n", from_units("cents", 2).alias("value")
    )


SQL_SESSIONS = f"""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id
            ORDER BY ts, event_id) <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS opens FROM events),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS "end", count(*) AS n,
        {sql_total(SQL_CENTS, 2)} AS value
    FROM numbered GROUP BY user_id, session"""


@query(SQL_SESSIONS)
def session_window(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user that end with four hours of silence."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    placed = timewindows.session_starts(
        events, ["user_id"], "ts", "event_id", 4 * 3600, "start"
    )
    return placed.groupBy("user_id", "start").agg(
        (F.max("ts") + F.expr("INTERVAL 4 HOURS")).alias("end"),
        F.count(F.lit(1)).alias("n"),
        from_units(exact_sum(units("value", 2)), 2).alias("value"),
    )
