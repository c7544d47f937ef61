"""Ranges of an ordered column that hold about equal numbers of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000
#: Ranges that one expression compares, and ranges at all: beyond 6.5 billion rows they grow longer.
MOST_COMPARED, MOST_RANGES = 1024, 65_536
DRAWN_PER_RANGE = 20


def edges_of(df: DataFrame, order: str) -> list:
    """Edges between ranges of about ROWS_PER_RANGE rows; none for a small table.

    Where the edges lie changes no result, only how even the ranges are: many edges come from values drawn at random.
    """
    filled = df.where(F.col(order).isNotNull())
    n = filled.count()
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE)
    if ranges < 2:
        return []
    if ranges > MOST_COMPARED:
        drawn = sorted(r[0] for r in filled.select(order).sample(min(1.0, DRAWN_PER_RANGE * ranges / n), seed=1).collect())
        return sorted(set(drawn[DRAWN_PER_RANGE::DRAWN_PER_RANGE]))
    return sorted(set(df.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], min(0.01, 0.5 / ranges))))


def range_of(order: str, edges: list, lo: int = 0, hi: int | None = None) -> Column:
    """Number of the range a value lies in: a balanced tree of comparisons, or a search. Nulls lie in the first range."""
    if len(edges) > MOST_COMPARED:
        ordered = np.array(edges)

        @F.pandas_udf("int")
        def search(values: pd.Series) -> pd.Series:
            return pd.Series(np.where(values.isna(), 0, np.searchsorted(ordered, values.fillna(ordered[0]), "left"))).astype("int32")

        return search(F.col(order))
    hi = len(edges) if hi is None else hi
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col(order) > edges[mid], range_of(order, edges, mid + 1, hi)).otherwise(range_of(order, edges, lo, mid))
