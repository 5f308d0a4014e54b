"""User functions that run on Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def price_per_size(price: pd.Series, size: pd.Series) -> pd.Series:
    return price / size


@F.pandas_udf(T.DoubleType())
def weighted_mean(totals: pd.Series, counts: pd.Series) -> float:
    """The mean of a group from the totals and counts of its parts."""
    return float(totals.sum() / counts.sum())


MOMENTS = "n long, sx double, sy double, sxx double, sxy double"


def moments(block: pd.DataFrame) -> dict[str, float]:
    """Sums from which a straight line through ``x`` and ``y`` follows."""
    x, y = block["x"].to_numpy(float), block["y"].to_numpy(float)
    return {"n": len(x), "sx": x.sum(), "sy": y.sum(), "sxx": (x * x).sum(), "sxy": (x * y).sum()}


def per_task(key: str, sums: Callable[[pd.DataFrame], dict]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` that adds up ``sums`` of each key's rows over all batches of a task.

    A task holds a row a key, so there should be few keys. Rows without a key are a key too.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: pd.DataFrame | None = None
        for batch in batches:
            rows = [{key: k, **sums(part)} for k, part in batch.groupby(key, dropna=False)]
            if rows:
                parts = pd.DataFrame(rows)
                totals = parts if totals is None else pd.concat([totals, parts]).groupby(key, dropna=False, as_index=False).sum()
        if totals is not None:
            yield totals

    return add_up


LINE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("line_number", T.IntegerType()), T.StructField("line", T.StringType())]
)


@F.arrow_udtf(returnType=LINE)
class Lines:
    """The lines of the texts of a table (``doc_id``, ``text``), numbered from 1. It takes whole batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        lines = pc.split_pattern(rows.column("text"), "\n")
        row, counts = pc.list_parent_indices(lines), pc.list_value_length(lines).drop_null().to_numpy()
        numbers = np.arange(1, counts.sum() + 1) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = [rows.column("doc_id").take(row), pa.array(numbers.astype(np.int32)), lines.flatten()]
        yield pa.table(columns, names=["doc_id", "line_number", "line"])
