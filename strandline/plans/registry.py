"""The list of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name. Without ``sql`` only its rows can be checked."""

    def add(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return add


def sql_units(column: str, scale: int) -> str:
    """SQL for ``strandline.functions.units``."""
    return f"CAST(round({column} * {10**scale}) AS BIGINT)"


def sql_total(whole: str, scale: int) -> str:
    """SQL for an exact sum of units, back as a double."""
    return f"CAST(sum({whole}) AS DOUBLE) / {10**scale}.0"
