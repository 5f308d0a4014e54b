"""Comparison of a query with its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd

TESTDATA = os.environ.get("STRANDLINE_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def text(value):
        if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
            value = value.tolist() if hasattr(value, "tolist") else list(value)
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, (int, float)):
            return repr(float(value))
        return repr(value)

    return sorted("|".join(text(v) for v in row) for row in frame.astype(object).values.tolist())


def differences(df, con, sql) -> list[str]:
    """What is unlike between a Spark result and a DuckDB result; empty where they agree."""
    relation = con.sql(sql)
    expected_types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    found_types = dict(df.dtypes)
    if sorted(expected_types) != sorted(found_types):
        return [f"columns {sorted(found_types)} but {sorted(expected_types)}"]
    problems = []
    for name, dtype in found_types.items():
        if SAME_TYPE.get(dtype, dtype) != expected_types[name]:
            problems.append(f"type of {name}: {dtype} but {expected_types[name]}")
    got, expected = canonical(df.toPandas()), canonical(relation.df())
    if len(got) != len(expected):
        problems.append(f"{len(got)} rows but {len(expected)}")
    elif got != expected:
        first = next(i for i, (a, b) in enumerate(zip(got, expected)) if a != b)
        problems.append(f"row {first}: {got[first]} but {expected[first]}")
    if not expected:
        problems.append("no rows expected: the check shows nothing")
    return problems
