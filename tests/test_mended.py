"""Inputs that earlier gave wrong or lost rows."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from gridloom import session
from gridloom.operators import aggregates, clean, encode, filters, forest, models, ordered, products, quantiles, sampling, series
from gridloom.plans.preprocess import build_features, run
from gridloom.schema import RAW_SCHEMA
from gridloom.sources import readings

ROW = {"timestamp_ntz": dt.datetime(2024, 1, 1), "double": 1.5, "int": 3, "bigint": 4, "string": "s"}


def raw(spark, n=60):
    rows = []
    for i in range(n):
        row = {f.name: ROW[f.dataType.simpleString()] for f in RAW_SCHEMA.fields}
        row |= {"datetime": dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "temperature": 20.0 + i, "humidity": 50.0 + i, "region": f"r{i % 3}", "total_load_mw": 100.0 + i}
        rows.append(tuple(row[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_csv_columns_are_matched_by_name(spark, folder):
    df = raw(spark)
    names = [f.name for f in RAW_SCHEMA.fields]
    mixed = df.select(*names[::-1], F.lit("x").alias("more"))
    mixed.write.option("header", True).csv(f"{folder}/raw")
    got = readings.read_csv(spark, f"{folder}/raw")
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    df.drop("humidity").write.option("header", True).csv(f"{folder}/less")
    with pytest.raises(ValueError, match="humidity"):
        readings.read_csv(spark, f"{folder}/less")


def test_duplicates_under_other_keys(spark):
    df = raw(spark).withColumn("reading_id", F.monotonically_increasing_id())
    twice = df.union(df.withColumn("reading_id", F.col("reading_id") + 10**12))
    assert sorted(r.reading_id for r in clean.drop_duplicate_rows(twice, "reading_id").collect()) == sorted(r.reading_id for r in df.collect())
    assert build_features(twice).count() == df.count()


def test_raw_rows_get_a_key(spark, folder):
    df = raw(spark)
    assert build_features(df.union(df)).count() == df.count()
    profile = {r["column"]: r["dtype"] for r in run(df, f"{folder}/out", "csv").collect()}
    assert profile["temperature"] == "double" and profile["region"] == "string"


def test_integers_are_interpolated_with_fractions(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    df = spark.createDataFrame([(at[0], 10, 0), (at[1], None, 1), (at[2], 13, 2)], "ts timestamp_ntz, v int, k int")
    assert [r.v for r in ordered.interpolate_time(df, ["v"], "ts", ["ts", "k"]).orderBy("k").collect()] == [10.0, 11.5, 13.0]


def test_rows_without_time_come_last_in_a_split(spark):
    rows = [(i, dt.datetime(2024, 1, 1, i % 24) if i % 10 else None) for i in range(100)]
    train, test = sampling.chronological_split(spark.createDataFrame(rows, "k long, ts timestamp_ntz"), "ts", "k")
    assert (train.count(), test.count()) == (80, 20)
    assert train.filter("ts is null").count() == 0
    first, rest = sampling.chronological_split(spark.createDataFrame(rows, "k long, ts timestamp_ntz"), "ts", "k", 0.95)
    assert (first.count(), rest.count(), first.filter("ts is null").count()) == (95, 5, 5)


def test_sample_has_the_smallest_hashes(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    want = [r.k for r in df.withColumn("h", sampling.hash_rank("k")).orderBy("h", "k").limit(50).collect()]
    assert [r.k for r in sampling.bounded_sample(df, "k", 50).collect()] == want
    same = spark.range(500).select(F.lit(7).alias("k"), "id")
    assert sampling.bounded_sample(same, "k", 50).count() == 50 and sampling.bounded_sample(same.limit(0), "k", 50).count() == 0


def test_hot_keys_are_not_shuffled(spark, folder):
    spark.range(100_000).select(F.lit("a").alias("region"), F.col("id").cast("double").alias("v")).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    for out in (encode.min_max(df, "v", "s", ("region",)), filters.long_enough(df, "region")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_spread_computes_nothing(spark, folder):
    spark.range(10).repartition(3).write.parquet(f"{folder}/t")
    assert session.spread(spark.read.parquet(f"{folder}/t")).count() == 10


def test_presets(spark):
    assert models.regressor_presets(200)["random_forest_reg"].estimator.getFeatureSubsetStrategy() == "all"
    assert models.classifier_presets(200)["lightgbm"].estimator.rows == 1.0
    assert len({models.classifier_presets()[n].estimator.grow for n in ("gradient_boosting", "xgboost", "lightgbm", "catboost")}) == 4
    assert models.ensemble_presets()["rf"].estimator.getMaxDepth() == 30


def test_correlations_with_nulls_and_nan(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) + [1e6, 0, 5]
    x[:, 1] += x[:, 0] - 1e6
    rows = [[float(v) if rng.random() > 0.1 else None for v in r] + [7.0, None] for r in x]
    rows[3][2] = float("nan")
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    got = {(r.left, r.right): r["corr"] for r in aggregates.correlations(df, list("abcde"), 9).collect()}
    both = [(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None]
    assert got["a", "b"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-8)
    assert got["a", "b"] == got["b", "a"] and got["a", "a"] == 1.0 and got["a", "d"] is None and got["d", "e"] is None and got["e", "e"] is None
    assert np.isnan(got["a", "c"]) and len(got) == 25


def test_keyed_products(spark):
    import numpy as np

    rows = [(k, [float(i), 1.0, float(i * k)]) for k in (1, 2) for i in range(50)] + [(3, [2.0, 3.0]), (None, [1.0, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>").repartition(3)
    got = {(r.k, r.i, r.j): (r.s, r.n) for r in products.keyed_products(df, "x", ["k"]).collect()}
    m = np.array([v for k, v in rows if k == 2])
    assert all(got[2, i, j] == ((m.T @ m)[i, j], 50) for i in range(3) for j in range(i, 3))
    assert got[3, 0, 1] == (6.0, 1) and got[None, 0, 0] == (1.0, 1) and len(got) == 18


def test_jobs_keep_and_reuse_models(spark, folder):
    rng = range(400)
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 7), float(i % 5), int(i % 7 > 3)) for i in rng], "k long, ts timestamp_ntz, a double, b double, y int")
    run_ = lambda split: models.compare_classifiers(df, ["a", "b"], "y", "k", 4, 4, ["random_forest", "xgboost"], f"{folder}/{split}", split, "ts")
    for split in ("stratified", "chronological"):
        first, again = run_(split), run_(split)
        assert first.results.collect() == again.results.collect() and first.results.count() == 3
    kept = models._kept(first, f"{folder}/job")
    model, about = models.load_model(spark, f"{folder}/job/best")
    assert about["best"] == kept.best_name and model.predict(df).count() == 400
    assert spark.read.option("header", True).csv(f"{folder}/job/comparison").count() == 3
    with pytest.raises(ValueError):
        models.compare_classifiers(df, ["a"], "y", "k", split="chronological")
    out = models.compare_regressors(df, ["a", "b"], "y", "ts", "k", 4, ["ridge", "xgboost_reg"], f"{folder}/reg")
    assert out.results.collect() == models.compare_regressors(df, ["a", "b"], "y", "ts", "k", 4, ["ridge", "xgboost_reg"], f"{folder}/reg").results.collect()


def test_quantiles_of_data_with_nan(spark):
    import math

    rows = [(i % 2, float(i)) for i in range(1000)] + [(i % 2, float("nan")) for i in range(100)] + [(0, None), (1, float("inf")), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    for by in ((), ("g",)):
        got = [sorted(map(str, quantiles.quantiles(df, ["v"], [0.0, 0.5, 0.9, 0.95, 1.0], by, n).collect())) for n in (10**6, 50)]
        assert got[0] == got[1] and "nan" in got[0][0]
    assert math.isnan(quantiles.order_statistics(df, "v", {(): [1101]}, (), 10)[((), 1101)])


def test_every_tree_draws_for_itself(spark):
    for n in (50, 1279, 1280, 6000):
        df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
        rows = forest._tree_rows(df, "k", ["x"], 20, 64, 1).select("tree", "k").collect()
        per = {t: len({r.k for r in rows if r.tree == t}) for t in range(20)}
        assert set(per.values()) == {min(n, 64)} and len(rows) == 20 * min(n, 64)
        used = len({r.k for r in rows})
        expected = n * (1 - (1 - min(n, 64) / n) ** 20)
        assert abs(used - expected) < 0.05 * expected + 1


def test_short_series_keep_their_steps(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("long", at + dt.timedelta(hours=i), float(i % 24) + i / 50) for i in range(400)]
    rows += [("short", at + dt.timedelta(hours=i), float(i)) for i in range(40)] + [("tiny", at + dt.timedelta(hours=i), 1.0) for i in range(11)]
    df = spark.createDataFrame(rows, "series_key string, ts timestamp_ntz, value double")
    train, test = series.split_last(df, 10)
    for forecast in (series.seasonal_forecast(train, test), series.window_forecast(train, test)):
        got = {r.series_key: (r.n, r.known) for r in forecast.groupBy("series_key").agg(F.count("*").alias("n"), F.count("forecast").alias("known")).collect()}
        assert got["long"] == (10, 10) and got["tiny"] == (10, 0) and got["short"][0] == 10
        assert forecast.filter("ts is null").count() == 0
        metrics = {r.series_key: r.rmse for r in series.forecast_metrics(test, forecast).collect()}
        assert metrics["long"] < 2 and metrics["tiny"] is None


def test_readings_are_extended_in_place_and_seen(spark):
    """A table that is read and written again, in front of it an older view of the same name."""
    from gridloom.sources import tables

    spark.sql("CREATE DATABASE IF NOT EXISTS extended LOCATION '" + tempfile.mkdtemp(prefix="run-", dir="/tmp") + "'")
    columns = "datetime string, region string, city string, total_load_mw double, available_power_mw double, outage_risk double, load_shedding_mw double, event string, temperature double, transformer_temp double, voltage double, frequency double, blackout int, overload int"
    row = lambda city, n: ("t", "r", city, 1.0 * n, 2.0, 3.0, 0.0, "e", 1.0, 1.0, 1.0, 1.0, 1, 0)
    spark.sql("USE extended")
    try:
        spark.createDataFrame([row("view", 9)], columns).createOrReplaceTempView(tables.READINGS)
        tables.register(spark.createDataFrame([row("a", 1)], columns), persist=True)
        assert [r.city for r in spark.table(tables.READINGS).collect()] == ["a"]
        tables.register(spark.table(tables.READINGS).union(spark.createDataFrame([row("b", 2)], columns)), persist=True)
        assert sorted(r.city for r in spark.table(tables.READINGS).collect()) == ["a", "b"]
        assert sorted(r.city for r in spark.table("v_blackout_events").collect()) == ["a", "b"]
        assert [t.name for t in spark.catalog.listTables("extended") if not t.isTemporary] == [tables.READINGS]
    finally:
        spark.sql("USE default")
