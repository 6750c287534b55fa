"""Sums of products of columns: small matrices per task, added up in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose mean shifts the columns, so that sums of squares keep their digits; any shift gives the same result.
SHIFT_ROWS = 1000

_SUMS = "i int, j int, n long, sx double, sxx double, sxy double, nan long"


def shifts(df: DataFrame, columns: list[str]) -> list[float]:
    """A first estimate of each column's mean; 0 where there is none."""
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).limit(SHIFT_ROWS).agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in columns]).first()
    return [v if v is not None and np.isfinite(v) else 0.0 for v in row]


def product_sums(df: DataFrame, columns: list[str], shift: list[float]) -> DataFrame:
    """For each ordered pair of columns, over the rows that have both, less their shifts: n, sums of x, x^2 and xy, NaN in x.

    Rows (i, j, n, sx, sxx, sxy, nan) with the numbers of the columns. Each task
    hands on one row per pair.
    """
    d = len(columns)
    at = np.array(shift)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, d, d))
        for batch in it:
            # Columns without a value are 0 and out of every count.
            x = np.empty((batch.num_rows, d))
            there = np.empty((batch.num_rows, d))
            for k in range(d):
                column = batch.column(k)
                there[:, k] = column.is_valid().to_numpy(zero_copy_only=False)
                x[:, k] = column.fill_null(at[k]).to_numpy(zero_copy_only=False)
            x -= at
            odd = np.isnan(x)
            x[odd] = 0.0
            sums += np.array([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x, odd.T.astype(float) @ there])
        i, j = (v.ravel() for v in np.indices((d, d)))
        n, sx, sxx, sxy, nan = (s.ravel() for s in sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n.astype(np.int64)), pa.array(sx), pa.array(sxx), pa.array(sxy), pa.array(nan.astype(np.int64))],
            ["i", "j", "n", "sx", "sxx", "sxy", "nan"])

    parts = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(add, _SUMS)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy", "nan")])


def sums_by_pair(df: DataFrame, columns: list[str], shift: list[float]) -> dict[str, np.ndarray]:
    """The sums as matrices [i, j]; only columns x columns numbers reach the driver."""
    out = {c: np.zeros((len(columns), len(columns))) for c in ("n", "sx", "sxx", "sxy", "nan")}
    for r in product_sums(df, columns, shift).collect():
        for c in out:
            out[c][r["i"], r["j"]] = r[c]
    return out


def keyed_products(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """Sums of products of all pairs of entries of an array column, per key: (keys..., i, j, s, n) with i <= j.

    Rows of a key that meet in a batch give one matrix; vectors of unlike
    lengths are added up entry by entry.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["_d"] = pdf["_x"].map(len)
            for key, part in pdf.groupby([*keys, "_d"], dropna=False, sort=False):
                x = np.array(part["_x"].tolist(), dtype=float)
                i, j = np.triu_indices(x.shape[1])
                first = part.iloc[[0] * len(i)][keys].reset_index(drop=True)
                yield first.assign(i=i.astype(np.int32), j=j.astype(np.int32), s=(x.T @ x)[i, j], n=len(x))

    full = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*keys, F.col(vector).alias("_x"))
    parts = full.mapInPandas(add, f"{kinds}, i int, j int, s double, n long")
    return parts.groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
