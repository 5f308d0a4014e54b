"""Queries with split plans against their SQL twins, on tables in which one key has a third of the rows."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.compare import TABLES, TESTDATA, database, differences

SKEWED = {
    "lineitem": """SELECT * REPLACE (
        CASE WHEN hash(l_partkey, l_extendedprice) % 3 = 0 THEN 77 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN hash(l_suppkey, l_extendedprice) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey)
        FROM lineitem""",
    "orders": """SELECT * REPLACE (
        CASE WHEN hash(o_orderkey) % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM orders""",
    "events": """SELECT * REPLACE (
        CASE WHEN hash(event_id) % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events""",
}
NAMES = """join_four_tables inner_join left_outer_join full_outer_join semi_join anti_join range_join
    interval_totals asof_join lateral_top_orders correlated_subquery percentiles arg_min_max
    distinct_and_filtered drop_duplicates total_order row_number ntile rank_with_ties relative_rank
    lag_lead_first moving_rows moving_range session_window stream_sessions grouped_map_udf""".split()


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = database(os.path.join(TESTDATA, "sf0.001"))
    for name in TABLES:
        con.execute(f"COPY ({SKEWED.get(name, f'FROM {name}')}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_one_key_has_a_third(skewed_dir):
    con = database(skewed_dir)
    for table, key in [("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("events", "user_id")]:
        largest = con.sql(f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})")
        assert largest.fetchall()[0][0] > 0.3


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_tables(spark, split_groups, skewed_dir, name):
    build, sql = entry_point.queries()[name], entry_point.oracle_sql()[name]
    assert differences(build(spark, skewed_dir), database(skewed_dir), sql) == []
