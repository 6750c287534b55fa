"""Isolation forest: trees grown in executors, rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.quantiles import quantiles
from gridloom.operators.sampling import hash_rank
from gridloom.session import materialize, spread

_NODE = "tree int, node int, feature int, threshold double, low int, high int, path double"
_ARRAYS = {"feature": np.int64, "threshold": float, "low": np.int64, "high": np.int64, "path": float}


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, low child, high child, path); leaves point to themselves."""
    nodes: list[tuple | None] = [None]
    todo = [(0, points, 0)]
    while todo:
        node, rows, depth = todo.pop()
        spread = rows.max(axis=0) > rows.min(axis=0) if len(rows) > 1 else np.zeros(rows.shape[1], bool)
        if depth >= depth_limit or not spread.any():
            nodes[node] = (node, 0, math.inf, node, node, depth + _mean_path(len(rows)))
            continue
        feature = int(rng.choice(np.flatnonzero(spread)))
        column = rows[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        below = column <= cut
        low, high = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[node] = (node, feature, cut, low, high, 0.0)
        todo += [(low, rows[below], depth + 1), (high, rows[~below], depth + 1)]
    return nodes


def _tree_rows(df: DataFrame, key: str, columns: list[str], trees: int, rows: int, seed: int) -> DataFrame:
    """``rows`` random rows for each tree, drawn independently of the other trees, whatever the size of the table.

    A row is in each tree's draw with the same small chance, so the number of
    its trees is binomial: one hash decides that number, and only rows in some
    tree rank the trees by further hashes. Draws come out a little large and
    are cut to ``rows``; a table of fewer rows is in every tree whole.
    """
    n = df.count()
    share = min(1.0, (rows + 10 * math.sqrt(rows) + 20) / max(n, 1))
    tails = _at_least(trees, share)
    u = (hash_rank(key, seed).cast("double") + 0.5) / F.lit(float(1 << 52))
    drawn = df.select(key, *columns).withColumn("_u", u).filter(F.col("_u") < tails[0])
    count = F.size(F.filter(F.array(*[F.lit(t) for t in tails]), lambda t: F.col("_u") < t))
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(F.col(key), t, F.lit(seed)).alias("_h"), t.alias("tree"))))
    pool = drawn.withColumn("_t", F.explode(F.slice(ranked, F.lit(1), count))).select(key, *columns, "_t._h", "_t.tree")
    pool = spread(materialize(pool, "forest-pool"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_h", key))
    return pool.withColumn("_n", place).filter(F.col("_n") <= rows)


def _at_least(n: int, p: float) -> list[float]:
    """Chance of at least 1, 2, ... successes in ``n`` tries, as long as it counts."""
    if p >= 1.0:
        return [1.0] * n
    each = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)]
    tails = [sum(each[k:]) for k in range(1, n + 1)]
    return [t for t in tails if t > 1e-18] or tails[:1]


@dataclass(frozen=True)
class IsolationForest:
    """Grown trees as arrays (tree x node); at most trees * 2 * rows nodes."""

    columns: list[str]
    sample_rows: int
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    path: np.ndarray

    def score(self, df: DataFrame) -> Column:
        """Negative isolation score: about -1 for anomalies, about -0.4 for normal rows."""
        shared = df.sparkSession.sparkContext.broadcast(
            (self.feature, self.threshold, self.low, self.high, self.path, _mean_path(self.sample_rows))
        )
        steps = math.ceil(math.log2(max(self.sample_rows, 2)))

        @F.pandas_udf("double")
        def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            feature, threshold, low, high, path, scale = shared.value
            for batch in batches:
                x = np.column_stack([s.to_numpy(float) for s in batch])
                at = np.arange(len(x))
                depth = np.zeros(len(x))
                for t in range(len(feature)):
                    node = np.zeros(len(x), dtype=np.int64)
                    for _ in range(steps):
                        left = x[at, feature[t, node]] <= threshold[t, node]
                        node = np.where(left, low[t, node], high[t, node])
                    depth += path[t, node]
                yield pd.Series(-np.exp2(-depth / len(feature) / scale))

        return isolation(*[F.col(c) for c in self.columns])

    def save(self, spark: SparkSession, path: str) -> None:
        """The nodes as a table, the names of the columns and the size of a tree's sample beside it."""
        tree, node = np.indices(self.feature.shape)
        cells = {"tree": tree, "node": node} | {name: getattr(self, name) for name in _ARRAYS}
        nodes = pd.DataFrame({name: values.ravel() for name, values in cells.items()})
        spark.createDataFrame(nodes, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = spark.createDataFrame([(self.columns, self.sample_rows)], "columns array<string>, sample_rows int")
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(about["columns"], about["sample_rows"], **_arrays(spark.read.parquet(f"{path}/nodes").toPandas()))


def _arrays(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Tree x node arrays of a table of nodes."""
    shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
    cells = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    arrays = {name: np.zeros(shape, dtype=kind) for name, kind in _ARRAYS.items()}
    for name, values in arrays.items():
        values[cells] = nodes[name].to_numpy()
    return arrays


def fit_isolation_forest(
    df: DataFrame, key: str, columns: list[str], trees: int = 200, rows: int = 256, seed: int = 42,
) -> IsolationForest:
    """Grow the trees side by side; each task holds one tree's few rows."""
    sample = _tree_rows(df, key, columns, trees, rows, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values(key)[columns].to_numpy(float)
        limit = math.ceil(math.log2(max(len(points), 2)))
        nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "low", "high", "path"])
        out.insert(0, "tree", tree)
        out["path"] = out["path"].astype(float)
        return out

    nodes = sample.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
    used = sample.groupBy("tree").count().agg(F.max("count")).first()[0]
    return IsolationForest(list(columns), int(used), **_arrays(nodes))


def isolation_flags(
    df: DataFrame, key: str, columns: list[str], contamination: float = 0.05, trees: int = 200, seed: int = 42,
    score: str = "if_score", flag: str = "if_anomaly",
) -> DataFrame:
    """Add score and 0/1 flag; the ``contamination`` share with the lowest scores is flagged.

    ``df`` is read twice: for the trees' rows and for scoring.
    """
    forest = fit_isolation_forest(df, key, columns, trees, seed=seed)
    scored = materialize(spread(df).withColumn(score, forest.score(df)), "forest-scores")
    cut = quantiles(scored, [score], [contamination]).first()["quantiles"][0]
    return scored.withColumn(flag, (F.col(score) < F.lit(cut)).cast("int"))
