"""Queries over the given tables, each with the SQL that must give the same rows."""

from strandline.plans import aggregation, joins, relational, scalars, streams, timewindows, udfs, windows
from strandline.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
