"""Readers, writers and shared scratch space."""

from strandline.sources.parquet import table, write_partitioned
from strandline.sources.scratch import clear_scratch, scratch_path, written

__all__ = ["clear_scratch", "scratch_path", "table", "write_partitioned", "written"]
