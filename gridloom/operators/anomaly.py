"""Anomaly detectors and their vote."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rounding import half_even
from gridloom.operators.density import clusters, noise_points
from gridloom.operators.encode import Scaler, fit_pca, fit_scaler
from gridloom.operators.forest import isolation_flags
from gridloom.operators.quantiles import quantiles
from gridloom.schema import ANOMALY_FEATURES, LIVE_ANOMALY_FEATURES
from gridloom.session import materialize, spread

_Z = "_z_"


def prepare(df: DataFrame, features=ANOMALY_FEATURES) -> tuple[DataFrame, list[str], Scaler]:
    """Add standardised copies ``_z_<feature>`` of the features that exist; nulls count as 0."""
    present = [c for c in features if c in df.columns]
    filled = df.withColumns({f"{_Z}{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present})
    scaled = [f"{_Z}{c}" for c in present]
    scaler = fit_scaler(filled, scaled)
    return scaler.apply(filled), scaled, scaler


def reconstruction_flags(
    df: DataFrame, columns: list[str], components: int = 8, percentile: float = 0.95,
    score: str = "ae_score", flag: str = "ae_anomaly",
) -> DataFrame:
    """Add the error of rebuilding a row from the main axes, and the flag above the percentile."""
    error = fit_pca(df, columns, components).reconstruction_error()
    scored = df.withColumn(score, error)
    cut = quantiles(scored, [score], [percentile]).first()["quantiles"][0]
    return scored.withColumn(flag, (F.col(score) > F.lit(cut)).cast("int"))


def density_flags(
    df: DataFrame, key: str, columns: list[str], eps: float = 0.8, min_points: int = 15, components: int = 5,
    flag: str = "dbscan_anomaly",
) -> DataFrame:
    """Flag the noise of density clustering on the first principal axes."""
    projection = fit_pca(df, columns, components)
    axes = [f"_a{i}" for i in range(len(projection.axes))]
    narrow = df.select(key, *[c.alias(a) for a, c in zip(axes, projection.coordinates())])
    noise = noise_points(narrow, key, axes, eps, min_points).withColumn(flag, F.lit(1))
    return df.join(noise, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def density_clusters(
    df: DataFrame, key: str, columns: list[str], eps: float = 0.8, min_points: int = 15, components: int = 5, label: str = "dbscan_cluster",
) -> DataFrame:
    """(key, label): cluster numbers of density clustering on the first principal axes, -1 for noise."""
    projection = fit_pca(df, columns, components)
    axes = [f"_a{i}" for i in range(len(projection.axes))]
    narrow = df.select(key, *[c.alias(a) for a, c in zip(axes, projection.coordinates())])
    return clusters(narrow, key, axes, eps, min_points).withColumnRenamed("cluster", label)


def boundary_flags(
    df: DataFrame, key: str, columns: list[str], nu: float = 0.05, waves: int = 256, seed: int = 42,
    score: str = "ocsvm_score", flag: str = "ocsvm_anomaly",
) -> DataFrame:
    """Flag the ``nu`` share of rows least similar to the whole under a Gaussian kernel.

    Random cosine features stand for the kernel with gamma = 1 / columns. The
    mean feature vector of all rows is the centre; a row's score is its mean
    kernel value with the table, up to the approximation.
    """
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 / len(columns)), (len(columns), waves))
    phases = rng.uniform(0.0, 2.0 * math.pi, waves)
    shared = df.sparkSession.sparkContext.broadcast((weights, phases))

    def features(frame: pd.DataFrame) -> np.ndarray:
        w, b = shared.value
        return math.sqrt(2.0 / w.shape[1]) * np.cos(frame[columns].to_numpy(float) @ w + b)

    def partial_sums(batches):
        for frame in batches:
            if len(frame):
                yield pd.DataFrame({"wave": np.arange(waves), "s": features(frame).sum(axis=0), "n": len(frame)})

    sums = spread(df.select(*columns)).mapInPandas(partial_sums, "wave int, s double, n long")
    means = sums.groupBy("wave").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    centre = np.zeros(waves)
    for row in means:
        centre[row["wave"]] = row["m"]

    @F.pandas_udf("double")
    def similarity(*parts: pd.Series) -> pd.Series:
        frame = pd.concat(parts, axis=1, keys=columns)
        return pd.Series(features(frame) @ centre)

    scored = materialize(spread(df).withColumn(score, similarity(*[F.col(c) for c in columns])), "boundary-scores")
    cut = quantiles(scored, [score], [nu]).first()["quantiles"][0]
    return scored.withColumn(flag, (F.col(score) < F.lit(cut)).cast("int"))


def _unit(column: str, ends: Column, invert: bool = False) -> Column:
    lo, hi = ends[column]["lo"], ends[column]["hi"]
    part = (F.col(column) - lo) / (hi - lo + F.lit(1e-9))
    return F.lit(1.0) - part if invert else part


def vote(
    df: DataFrame, flags=("if_anomaly", "ae_anomaly", "dbscan_anomaly"), forest_score: str = "if_score",
    error_score: str = "ae_score", literal: bool = False,
) -> DataFrame:
    """Add vote, majority flag and the 0..100 score.

    The forest score is high for normal rows, so it enters inverted;
    ``literal=True`` adds it as it is.
    """
    ends = df.agg(
        F.struct(
            *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in (forest_score, error_score)]
        ).alias("s")
    ).scalar()
    votes = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    raw = (
        F.col("anomaly_vote") / F.lit(float(len(flags))) * 0.4
        + _unit(forest_score, ends, invert=not literal) * 0.3
        + _unit(error_score, ends) * 0.3
    )
    return df.withColumn("anomaly_vote", votes).withColumns(
        {"is_anomaly": (F.col("anomaly_vote") >= 2).cast("int"), "anomaly_risk_score": half_even(raw * 100, 2)}
    )


def detect_anomalies(
    df: DataFrame, key: str, features=ANOMALY_FEATURES, contamination: float = 0.05, trees: int = 200,
    components: int = 8, eps: float = 0.8, min_points: int = 15, literal: bool = False,
) -> DataFrame:
    """Run the three detectors on all rows and combine them.

    The detectors work on the key and the scaled features only; their columns
    join the wide table once, on the unique key.
    """
    prepared, columns, _ = prepare(df, features)
    narrow = materialize(prepared.select(key, *columns), "anomaly-features")
    found = isolation_flags(narrow, key, columns, contamination, trees)
    found = reconstruction_flags(found, columns, components)
    found = density_flags(found, key, columns, eps, min_points)
    results = materialize(vote(found, literal=literal).drop(*columns), "anomaly-results")
    return df.join(results, key)


def live_anomalies(df: DataFrame, key: str, trees: int = 100, contamination: float = 0.05) -> DataFrame:
    """The short form: one forest over six measured columns."""
    prepared, columns, _ = prepare(df, LIVE_ANOMALY_FEATURES)
    narrow = materialize(prepared.select(key, *columns), "anomaly-features")
    out = isolation_flags(narrow, key, columns, contamination, trees, score="anomaly_score", flag="is_anomaly")
    return df.join(out.drop(*columns), key)


def top_anomalies(df: DataFrame, key: str, rows: int = 10) -> DataFrame:
    return (
        df.filter(F.col("is_anomaly") == 1)
        .orderBy(F.desc("anomaly_risk_score"), key)
        .limit(rows)
        .select(key, "datetime", "region", "city", "total_load_mw", "outage_risk", "anomaly_risk_score")
    )
