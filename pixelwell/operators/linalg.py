"""Least squares in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The R factor of all rows that a task reads, merged batch by batch: as many rows as columns at most."""
    r = None
    for pdf in batches:
        rows = pdf.to_numpy(np.float64)
        if len(rows):
            r = np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")
    if r is not None:
        yield pd.DataFrame(r, columns=[f"c{i}" for i in range(r.shape[1])])


def least_squares(df: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
    """The len(a) x len(b) matrix X of least norm that minimises |A X - B|; rows with nulls are left out, without rows X is 0.

    Tasks reduce [A | B] to triangles of len(a) + len(b) rows, which are merged; normal equations, which square the
    condition number, aren't formed.
    """
    if not a or not b:
        raise ValueError("both sides need columns")
    rows = df.dropna(subset=[*a, *b]).select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*a, *b])])
    got = rows.mapInPandas(_triangles, rows.schema).repartition(1).mapInPandas(_triangles, rows.schema).toPandas().to_numpy(np.float64)
    k = len(a)
    if not len(got):
        return np.zeros((k, len(b)))
    return np.linalg.lstsq(got[:k, :k], got[:k, k:], rcond=None)[0]


def simple_fit(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """One row: slope_<y> and offset_<y> of each y against x, from centred sums."""
    slope = {y: F.try_divide(F.covar_pop(x, y), F.var_pop(x)) for y in ys}
    return df.agg(*[e for y in ys for e in (slope[y].alias(f"slope_{y}"), (F.avg(y) - slope[y] * F.avg(x)).alias(f"offset_{y}"))])
