"""Steps of the feature table that read less than the whole table for a small question."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import clean, ordered
from gridloom.plans import preprocess
from gridloom.schema import RAW_SCHEMA


def test_few_gaps_move_the_filled_columns_only(spark, monkeypatch):
    df = spark.range(3000).select(
        F.col("id").alias("_row"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 3, F.col("id") * 1.5).alias("x"),
        F.when((F.col("id") > 40) & (F.col("id") < 2990), F.col("id")).alias("y"), F.rand(1).alias("other"))
    df = df.orderBy("k", "_row").localCheckpoint()
    rows = ordered.materialize(df.drop("_row").withColumn("_row", F.row_number().over(ordered.Window.orderBy("k", "y", "x", "other")) - 1), "gaps")
    for by in ([], ["k"]):
        for last in (0, None):
            few = ordered.fill_next(rows, ["x", "y"], ["_row"], by, 70, last, "_row")
            assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
            with monkeypatch.context() as patch:
                patch.setattr(ordered, "SMALL_ROWS", 5)
                many = ordered.fill_next(rows, ["x", "y"], ["_row"], by, 70, last, "_row")
            assert few.dtypes == many.dtypes == rows.dtypes
            assert few.count() == 3000 and few.exceptAll(many).count() == 0


VALUES = {
    "temperature": "id % 100",                                    # no outlier
    "humidity": "if(id = 7, 1e6, id % 100)",                      # above
    "voltage": "if(id = 7, -1e6, id % 100)",                      # below
    "frequency": "cast(null as double)",
    "transformer_temp": "1.0D",
    "outage_risk": "if(id % 10 = 0, double('nan'), id % 100)",
    "total_load_mw": "-100.0D * ln(1 - (id + 0.5) / 1000)",
    "available_power_mw": "if(id < 997, id % 100, 173.8)",        # next to the limit
}


def _exact(df):
    limits = clean.iqr_limits(df, list(VALUES))
    found = df.agg(*[F.count_if(clean._outside(c, limits[c])).alias(c) for c in limits]).first()
    return [c for c in VALUES if c in limits and found[c]]


def test_columns_with_outliers_are_those_of_exact_quartiles(spark, monkeypatch):
    df = spark.range(1000).selectExpr(*[f"cast({e} as double) as {c}" for c, e in VALUES.items()]).localCheckpoint()
    want = _exact(df)
    assert {"humidity", "voltage", "total_load_mw"} <= set(want) and "temperature" not in want
    assert clean.columns_with_outliers(df, list(VALUES)) == want
    asked = []
    monkeypatch.setattr(clean, "quantiles", lambda d, columns, *a: asked.extend(columns) or pytest.fail(str(columns)))
    clean.clip_outliers(df.select("temperature", "humidity", "voltage", "frequency"))
    assert not asked


def test_lags_come_before_derived_columns(spark, sf, monkeypatch):
    from checks.base import readings

    seen, real = [], preprocess.with_lag_features
    monkeypatch.setattr(preprocess, "with_lag_features", lambda df, *a: seen.extend(df.columns) or real(df, *a))
    out = preprocess.build_features(readings(spark, sf))
    assert "load_ratio" not in seen and "hour_sin" not in seen
    place = {c: i for i, c in enumerate(out.columns)}
    assert len(place) == 76 and place[RAW_SCHEMA.fields[0].name] < place["hour_sin"] < place["load_ratio"] < place["load_lag_1h"] < place["city_enc"]
