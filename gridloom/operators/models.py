"""Classifier and regressor presets, training, comparison and ensembles."""

from __future__ import annotations

import json
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.boosting import BoostedTrees, Boosting, bin_cuts
from gridloom.operators.boosting import fit as fit_boosted
from gridloom.operators.encode import Scaler, class_weights, feature_matrix, fit_scaler
from gridloom.operators.metrics import classification_metrics, regression_metrics
from gridloom.operators.random_forest import Forest, ForestModel, forest_cuts
from gridloom.operators.random_forest import fit as fit_forest
from gridloom.operators.sampling import chronological_split, stratified_split
from gridloom.schema import BLACKOUT_FEATURES, DEMAND_FEATURES, OVERLOAD_FEATURES
from gridloom.session import materialize, spread
from gridloom.sources.readings import exists

log = logging.getLogger(__name__)

SEED = 42
#: Fits that run at a time: all of a job, since boosting on a small table keeps one core busy.
FITS = 8
#: Spark's own limit of a tree's depth; stands for "no limit".
DEEPEST = 30


@dataclass(frozen=True)
class Preset:
    """An estimator with the row weights and scaling it is trained with."""

    estimator: object
    weights: str | float | None = None  # "balanced", a weight for positives, or none
    scaled: bool = False


def classifier_presets(trees: int = 200, n_rows: int | None = None) -> dict[str, Preset]:
    """Six classifiers; the boosted ones grow by variance, by level, by leaf and in symmetric levels.

    ``n_rows`` is the total training weight: the linear penalty is 1 / (C * n).
    """
    return {
        "logistic_regression": Preset(
            LogisticRegression(
                maxIter=1000, tol=1e-4, regParam=1.0 / (0.1 * (n_rows or 1)), elasticNetParam=0.0, standardization=False,
                labelCol="label", featuresCol="features",
            ), "balanced", scaled=True,
        ),
        "random_forest": Preset(
            RandomForestClassifier(
                numTrees=trees, maxDepth=12, minInstancesPerNode=5, seed=SEED, labelCol="label",
                featuresCol="features", maxMemoryInMB=512,
            ), "balanced",
        ),
        "gradient_boosting": Preset(Boosting(trees, 0.05, 5, "variance", rows=0.8)),
        "xgboost": Preset(Boosting(trees, 0.05, 6, "level", rows=0.8, columns=0.8, least_weight=1.0), 5.0),
        "lightgbm": Preset(Boosting(trees, 0.05, 6, "leaf", leaves=31, columns=0.8, ridge=0.0, least_rows=20, least_weight=1e-3), "balanced"),
        "catboost": Preset(Boosting(trees, 0.05, 6, "symmetric", ridge=3.0), "balanced"),
    }


def ensemble_presets(trees: int = 100) -> dict[str, Preset]:
    """The three members of the soft vote."""
    return {
        "rf": Preset(
            RandomForestClassifier(
                numTrees=trees, maxDepth=DEEPEST, seed=SEED, labelCol="label", featuresCol="features", maxMemoryInMB=512,
            ), "balanced",
        ),
        "xgb": Preset(Boosting(trees, 0.3, 6, "level", least_weight=1.0), 5.0),
        "lgb": Preset(Boosting(trees, 0.1, DEEPEST, "leaf", leaves=31, ridge=0.0, least_rows=20, least_weight=1e-3), "balanced"),
    }


def regressor_presets(trees: int = 200, n_rows: int | None = None, label_std: float = 1.0) -> dict[str, Preset]:
    """Four regressors. Spark divides the linear penalty by the label's deviation, hence ``label_std``."""
    return {
        "ridge": Preset(
            LinearRegression(
                regParam=label_std / (n_rows or 1), elasticNetParam=0.0, standardization=False, solver="normal",
                labelCol="label", featuresCol="features",
            )
        ),
        "random_forest_reg": Preset(
            RandomForestRegressor(
                numTrees=trees, maxDepth=12, featureSubsetStrategy="all", seed=SEED, labelCol="label", featuresCol="features",
                maxMemoryInMB=512,
            )
        ),
        "xgboost_reg": Preset(Boosting(trees, 0.05, 6, "level", least_weight=1.0, loss="squared")),
        "lightgbm_reg": Preset(Boosting(trees, 0.05, 6, "leaf", leaves=31, ridge=0.0, least_rows=20, least_weight=1e-3, loss="squared")),
    }


@dataclass
class Trained:
    """A fitted model with the feature columns and the scaler it needs."""

    name: str
    features: list[str]
    model: PipelineModel | BoostedTrees | ForestModel
    scaler: Scaler | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classifiers, ``score`` = probability of class 1."""
        out = self.model.transform(_scaled(df, self.features, self.scaler))
        if "probability" in out.columns:
            out = out.withColumn("score", vector_to_array("probability")[1])
        drop = [c for c in ("features", "rawPrediction", "probability", *[f"_s_{f}" for f in self.features]) if c in out.columns]
        return out.drop(*drop)


@dataclass
class Ensemble:
    """Soft vote: the mean probability of the members, class 1 from one half."""

    name: str
    features: list[str]
    members: list[Trained] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for i, member in enumerate(self.members):
            out = member.predict(out).withColumnRenamed("score", f"_p{i}").drop("prediction")
        mean = sum((F.col(f"_p{i}") for i in range(1, len(self.members))), F.col("_p0")) / len(self.members)
        return out.withColumn("score", mean).withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop(
            *[f"_p{i}" for i in range(len(self.members))]
        )


def _scaled(df: DataFrame, features: list[str], scaler: Scaler | None) -> DataFrame:
    return scaler.apply(df, "_s_") if scaler else df


class Bins:
    """Bins of one training table: the first of several fits finds them, the others take them."""

    def __init__(self):
        self._found, self._locks = {}, {}

    def __call__(self, find, df: DataFrame, features: list[str], bins: int, n: int) -> list[list[float]]:
        with self._locks.setdefault((find, bins), Lock()):
            if (find, bins) not in self._found:
                self._found[find, bins] = find(df, features, bins, n)
            return self._found[find, bins]


def train(train_df: DataFrame, features: list[str], target: str, preset: Preset, name: str, bins: Bins | None = None) -> Trained:
    """Fit one preset; rows are read from ``train_df``, which the caller has written. Fits of the same columns and target may share ``bins``."""
    bins = bins or Bins()
    rows = train_df.withColumn("label", F.col(target).cast("double"))
    scaler = fit_scaler(rows, features) if preset.scaled else None
    estimator = preset.estimator
    if preset.weights is not None:
        positive = None if preset.weights == "balanced" else preset.weights
        rows = class_weights(rows, "label", "weight", positive)
        if not isinstance(estimator, Boosting):
            estimator = estimator.copy({estimator.weightCol: "weight"})
    if isinstance(estimator, Boosting):
        weight = None if preset.weights is None else "weight"
        return Trained(name, list(features), fit_boosted(rows, list(features), "label", estimator, weight, partial(bins, bin_cuts)))
    if isinstance(estimator, (RandomForestClassifier, RandomForestRegressor)):
        weights = (1.0, 1.0)
        if preset.weights is not None:
            known = {r["label"]: r["weight"] for r in rows.filter("label is not null").groupBy("label").agg(F.first("weight").alias("weight")).collect()}
            weights = (known.get(0.0, 1.0), known.get(1.0, 1.0))
        return Trained(name, list(features), fit_forest(rows, list(features), "label", Forest.of(estimator, weights), partial(bins, forest_cuts)))
    inputs = [f"_s_{f}" for f in features] if scaler else list(features)
    stages = [VectorAssembler(inputCols=inputs, outputCol="features"), estimator]
    return Trained(name, list(features), Pipeline(stages=stages).fit(_scaled(rows, features, scaler)), scaler)


def train_evaluate_classifier(train_df, test_df, features, target, preset, name) -> tuple[DataFrame, Trained]:
    trained = train(train_df, features, target, preset, name)
    predicted = trained.predict(test_df)
    return classification_metrics(predicted, target, "prediction", "score").withColumn("model", F.lit(name)), trained


def train_evaluate_regressor(train_df, test_df, features, target, preset, name) -> tuple[DataFrame, Trained]:
    trained = train(train_df, features, target, preset, name)
    return regression_metrics(trained.predict(test_df), target, "prediction").withColumn("model", F.lit(name)), trained


def train_ensemble(train_df: DataFrame, features: list[str], target: str, trees: int = 100, bins: Bins | None = None) -> Ensemble:
    presets, bins = ensemble_presets(trees), bins or Bins()
    members = _side_by_side(lambda name: train(train_df, features, target, presets[name], name, bins), presets)
    return Ensemble("ensemble_voting", list(features), members)


def feature_importance(trained: Trained | Ensemble, spark: SparkSession, rows: int = 20) -> DataFrame:
    """Largest tree importances or absolute coefficients; of an ensemble, those of its first member."""
    if isinstance(trained, Ensemble):
        trained = trained.members[0]
    fitted = trained.model if isinstance(trained.model, (BoostedTrees, ForestModel)) else trained.model.stages[-1]
    if isinstance(fitted, (BoostedTrees, ForestModel)):
        values = fitted.importances
    elif hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficients"):
        values = abs(fitted.coefficients.toArray())
    else:
        raise TypeError(f"{type(fitted).__name__} has no importances")
    pairs = [(f, float(v)) for f, v in zip(trained.features, values)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(rows)


@dataclass
class Comparison:
    """Metrics of all models, best first, and the best model."""

    results: DataFrame
    best: Trained | Ensemble
    best_name: str
    best_value: float
    metric: str


def _measured(table: DataFrame, model) -> tuple[Row, StructType, object]:
    """The one row of a metric table, its schema and the model."""
    return table.first(), table.schema, model


def _compare(spark: SparkSession, done: list[tuple[Row, StructType, object]], metric: str, lowest: bool) -> Comparison:
    """Rank the models by their metrics and pick the best."""
    rows = [(row, model) for row, _, model in done]
    schema = done[0][1]
    ranked = sorted(rows, key=lambda pair: (pair[0][metric] if lowest else -pair[0][metric], pair[0]["model"]))
    results = spark.createDataFrame([r for r, _ in ranked], schema)
    best_row, best = ranked[0]
    return Comparison(results, best, best_row["model"], best_row[metric], metric)


def _table(df: DataFrame, features, target: str, *keep: str) -> tuple[DataFrame, list[str]]:
    present = [f for f in features if f in df.columns]
    rows = feature_matrix(df, features, target if target not in present else None)
    extra = [c for c in keep if c not in rows.columns]
    rows = df.select(*rows.columns, *extra).fillna(0, subset=present)
    return rows, present


def _parts(parts: tuple[DataFrame, DataFrame], label: str) -> tuple[DataFrame, DataFrame]:
    """Both parts of a split as written tables: every fit reads them, none computes them again."""
    train_df, test_df = (materialize(part, f"{label}-{name}") for part, name in zip(parts, ("train", "test")))
    return spread(train_df), test_df


def _fitted(store: str | None, name: str, spark: SparkSession, fit):
    """The model kept under ``store``, or a new one, which is then kept there."""
    path = f"{store.rstrip('/')}/{name}" if store else None
    if path and exists(spark, f"{path}/about/_SUCCESS"):
        return load_model(spark, path)[0]
    model = fit()
    if path:
        save_model(model, path)
    return model


def compare_classifiers(
    df: DataFrame, features, target: str, key: str, trees: int = 200, ensemble_trees: int | None = None,
    names: list[str] | None = None, store: str | None = None, split: str = "stratified", ts: str | None = None,
) -> Comparison:
    """Train the presets and rank them by F1 on the test rows.

    ``split`` is "stratified", or "chronological" along ``ts``. The fits run side
    by side on the written rows; each fit is distributed. Models found
    under ``store`` are used instead of being trained; new ones are kept there.
    """
    if split not in ("stratified", "chronological") or (split == "chronological" and not ts):
        raise ValueError(f"no split {split!r}, or no time column for it")
    rows, present = _table(df, features, target, key, *([ts] if ts else []))
    parts = stratified_split(rows, key, target) if split == "stratified" else chronological_split(rows, ts, key)
    train_df, test_df = _parts(parts, "classifiers")
    spark, presets, bins = df.sparkSession, classifier_presets(trees, train_df.count()), Bins()
    names = list(presets if names is None else names)

    def fit(name: str):
        if name == "ensemble":
            return train_ensemble(train_df, present, target, ensemble_trees, bins)
        return train(train_df, present, target, presets[name], name, bins)

    def measured(name: str) -> tuple[Row, StructType, object]:
        model = _fitted(store, f"{target}-{name}", spark, lambda: fit(name))
        # Metrics take several passes over the predictions.
        predicted = materialize(model.predict(test_df).select(target, "prediction", "score"), "predicted")
        return _measured(classification_metrics(predicted, target, "prediction", "score").withColumn("model", F.lit(model.name)), model)

    done = _side_by_side(measured, [*names, *(["ensemble"] if ensemble_trees else [])])
    return _compare(spark, done, "f1_score", lowest=False)


def compare_regressors(
    df: DataFrame, features, target: str, ts: str, key: str, trees: int = 200, names: list[str] | None = None, store: str | None = None,
) -> Comparison:
    """Train on the first 80 % in time, rank by RMSE on the rest. ``store`` as for the classifiers."""
    rows, present = _table(df, features, target, ts, key)
    train_df, test_df = _parts(chronological_split(rows, ts, key), "regressors")
    size = train_df.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
    spark, presets, bins = df.sparkSession, regressor_presets(trees, size["n"], size["s"] or 1.0), Bins()

    def measured(name: str) -> tuple[Row, StructType, Trained]:
        model = _fitted(store, f"{target}-{name}", spark, lambda: train(train_df, present, target, presets[name], name, bins))
        return _measured(regression_metrics(model.predict(test_df), target, "prediction").withColumn("model", F.lit(model.name)), model)

    done = _side_by_side(measured, names or presets)
    return _compare(spark, done, "rmse", lowest=True)


def _side_by_side(fit, names) -> list:
    """Fits of several presets at a time: boosting runs one task, or many short jobs, which leave most of a cluster idle."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(fit), names))


def _kept(comparison: Comparison, path: str | None) -> Comparison:
    """Saves the best model with its metadata, and the comparison table, if a folder is given."""
    if path:
        about = {"best": comparison.best_name, "metric": comparison.metric, "value": comparison.best_value}
        save_model(comparison.best, f"{path.rstrip('/')}/best", about)
        save_comparison(comparison, f"{path.rstrip('/')}/comparison")
    return comparison


def blackout_job(df: DataFrame, key: str, trees: int = 200, ensemble_trees: int = 100, path: str | None = None, **options) -> Comparison:
    """All classifiers and the ensemble; ``path`` keeps the best model and the table. ``options``: split, ts, store."""
    return _kept(compare_classifiers(df, BLACKOUT_FEATURES, "blackout", key, trees, ensemble_trees, **options), path)


def overload_job(df: DataFrame, key: str, trees: int = 200, path: str | None = None, **options) -> Comparison:
    return _kept(compare_classifiers(df, OVERLOAD_FEATURES, "overload", key, trees, **options), path)


def demand_job(df: DataFrame, ts: str, key: str, trees: int = 200, path: str | None = None, **options) -> Comparison:
    return _kept(compare_regressors(df, DEMAND_FEATURES, "total_load_mw", ts, key, trees, **options), path)


def save_comparison(comparison: Comparison, path: str) -> None:
    """Write the comparison table; the confusion matrix becomes JSON text for CSV."""
    out = comparison.results
    if "confusion_matrix" in out.columns:
        out = out.withColumn("confusion_matrix", F.to_json("confusion_matrix"))
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: Trained | Ensemble, path: str, metadata: dict | None = None) -> None:
    """Write the fitted stages and a one-row table with names, scaler and metadata."""
    members = model.members if isinstance(model, Ensemble) else [model]
    spark = SparkSession.active()
    for i, member in enumerate(members):
        if isinstance(member.model, (BoostedTrees, ForestModel)):
            member.model.save(spark, f"{path}/member-{i}")
        else:
            member.model.write().overwrite().save(f"{path}/member-{i}")
    about = {
        "name": model.name, "features": model.features, "ensemble": isinstance(model, Ensemble),
        "members": [{"name": m.name, "scaler": m.scaler.stats if m.scaler else None, "boosted": isinstance(m.model, BoostedTrees), "forest": isinstance(m.model, ForestModel)} for m in members],
    }
    row = spark.createDataFrame([(json.dumps(about), json.dumps(metadata or {}))], "about string, metadata string")
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[Trained | Ensemble, dict]:
    row = spark.read.parquet(f"{path}/about").first()
    about = json.loads(row["about"])
    members = [
        Trained(
            m["name"], about["features"],
            (BoostedTrees if m.get("boosted") else ForestModel).load(spark, f"{path}/member-{i}") if m.get("boosted") or m.get("forest")
            else PipelineModel.load(f"{path}/member-{i}"),
            Scaler({c: tuple(s) for c, s in m["scaler"].items()}) if m["scaler"] else None,
        )
        for i, m in enumerate(about["members"])
    ]
    model = Ensemble(about["name"], about["features"], members) if about["ensemble"] else members[0]
    return model, json.loads(row["metadata"])
