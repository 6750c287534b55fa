"""One-class machine with a Gaussian kernel: a boundary that leaves about ``nu`` of the rows outside.

The dual problem is solved on a sample of at most ``SAMPLE`` rows, the size at
which the boundary is defined; one task holds the sample and one column of the
kernel at a time. The support vectors then score all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.sampling import bounded_sample

#: Rows the boundary is fitted on, at most.
SAMPLE = 5000
#: Largest violation of the optimality conditions that a solution may leave.
TOLERANCE = 1e-3
#: Rows scored at once, so that a kernel block stays at 512 x SAMPLE numbers.
BLOCK = 512
#: Kernel columns kept while solving.
KEPT_COLUMNS = 512

_MODEL = "place int, vector array<double>, weight double, rho double, gamma double"


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of every row of ``a`` to every row of ``b``."""
    distance = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-gamma * np.maximum(distance, 0.0))


def solve(x: np.ndarray, nu: float, gamma: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights in 0..1 that add up to ``nu * rows`` and make the kernel form least, and the offset.

    Each step moves weight between two rows: the one with the smallest gradient
    that may still gain, and the one whose loss lowers the form most. It ends
    when no row that may lose lies more than ``tolerance`` above one that may gain.
    """
    n = len(x)
    total = min(max(nu, 0.0), 1.0) * n
    weight = np.clip(total - np.arange(n), 0.0, 1.0)

    @lru_cache(maxsize=KEPT_COLUMNS)
    def column(i: int) -> np.ndarray:
        return kernel(x, x[i : i + 1], gamma)[:, 0]

    held = weight > 0
    gradient = np.concatenate([kernel(x[s : s + BLOCK], x[held], gamma) @ weight[held] for s in range(0, n, BLOCK)])
    while True:
        i = int(np.argmin(np.where(weight < 1.0, gradient, np.inf)))
        above = np.where(weight > 0.0, gradient - gradient[i], -np.inf)
        if weight[i] >= 1.0 or above.max() <= tolerance:
            break
        bend = np.maximum(2.0 - 2.0 * column(i), 1e-12)
        j = int(np.argmax(np.where(above > 0.0, above * above / bend, -np.inf)))
        room, stock, best = 1.0 - weight[i], weight[j], above[j] / bend[j]
        step = min(room, stock, best)
        weight[i] = 1.0 if step == room else weight[i] + step
        weight[j] = 0.0 if step == stock else weight[j] - step
        gradient += step * (column(i) - column(j))
    free = (weight > 0.0) & (weight < 1.0)
    if free.any():
        return weight, float(gradient[free].mean())
    ends = [part for part in (gradient[weight >= 1.0].max(initial=-np.inf), gradient[weight <= 0.0].min(initial=np.inf)) if np.isfinite(part)]
    return weight, float(np.mean(ends))


@dataclass(frozen=True)
class OneClassMachine:
    """Support vectors with their weights; at most ``SAMPLE`` of them."""

    columns: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    rho: float
    gamma: float

    def score(self, df: DataFrame) -> Column:
        """Signed distance to the boundary, below 0 outside; null where a column is null or not finite."""
        if not len(self.weights):
            return F.lit(None).cast("double")
        shared = df.sparkSession.sparkContext.broadcast((self.vectors, self.weights, self.rho, self.gamma))

        @F.pandas_udf("double")
        def distance(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            vectors, weights, rho, gamma = shared.value
            for batch in batches:
                x = np.column_stack([s.to_numpy(float, na_value=np.nan) for s in batch])
                out = pd.Series(np.nan, index=range(len(x)), dtype="Float64")
                whole = np.flatnonzero(np.isfinite(x).all(axis=1))
                for s in range(0, len(whole), BLOCK):
                    at = whole[s : s + BLOCK]
                    out.iloc[at] = kernel(x[at], vectors, gamma) @ weights - rho
                yield out

        value = distance(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        return F.when(~F.isnan(value), value)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per support vector; the names of the columns go beside them."""
        rows = [
            (i, v.tolist(), float(w), self.rho, self.gamma) for i, (v, w) in enumerate(zip(self.vectors, self.weights))
        ]
        spark.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/vectors")
        names = spark.createDataFrame(list(enumerate(self.columns)), "place int, name string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneClassMachine:
        names = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("place").collect()]
        return cls._of(names, spark.read.parquet(f"{path}/vectors").orderBy("place").collect())

    @classmethod
    def _of(cls, columns, rows) -> OneClassMachine:
        vectors = np.array([r["vector"] for r in rows], dtype=float).reshape(len(rows), len(columns))
        first = rows[0] if rows else {"rho": 0.0, "gamma": 1.0}
        return cls(list(columns), vectors, np.array([r["weight"] for r in rows]), first["rho"], first["gamma"])


def fit_one_class(
    df: DataFrame, key: str, columns: list[str], nu: float = 0.05, rows: int = SAMPLE, gamma: float | None = None,
    seed: int = 42, tolerance: float = TOLERANCE,
) -> OneClassMachine:
    """Fit on ``rows`` rows of the smallest key hash; gamma is 1 / columns unless given.

    Rows with a null or a value that is not finite take no part. A table
    without rows gives a machine that scores null.
    """
    width = gamma if gamma is not None else 1.0 / len(columns)
    numbers = df.select(F.col(key).alias("_key"), *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    names = [f"_x{i}" for i in range(len(columns))]
    finite = F.lit(True)
    for c in names:
        finite = finite & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    sample = bounded_sample(numbers.filter(finite), "_key", rows, seed)

    def support(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_key", ignore_index=True)[names].to_numpy(float)
        weight, rho = solve(x, nu, width, tolerance)
        held = np.flatnonzero(weight > 0.0)
        return pd.DataFrame({
            "place": held, "vector": list(x[held]), "weight": weight[held], "rho": rho, "gamma": width})

    found = sample.groupBy().applyInPandas(support, _MODEL).orderBy("place").collect()
    return OneClassMachine._of(columns, found)


def one_class_flags(
    df: DataFrame, key: str, columns: list[str], nu: float = 0.05, score: str = "ocsvm_score", flag: str = "ocsvm_anomaly",
) -> DataFrame:
    """Add the score and 1 for rows outside the boundary; both are null where a column is null or not finite."""
    machine = fit_one_class(df, key, columns, nu)
    return df.withColumn(score, machine.score(df)).withColumn(flag, (F.col(score) < 0).cast("int"))
