import pytest
from pyspark.sql import functions as F

from checks.base import gappy, readings
from gridloom.operators import models
from gridloom.operators.encode import feature_matrix
from gridloom.plans import dashboard, preprocess
from gridloom.schema import BLACKOUT_FEATURES, DEMAND_FEATURES, OVERLOAD_FEATURES, RAW_SCHEMA, RISK_FEATURES
from gridloom.sources import readings as src
from gridloom.sources import tables
from gridloom.streaming import score


@pytest.fixture(scope="module")
def built(spark, sf):
    return preprocess.build_features(gappy(spark, sf), block_rows=200).cache()


def test_feature_lists():
    assert [len(f) for f in (BLACKOUT_FEATURES, OVERLOAD_FEATURES, RISK_FEATURES, DEMAND_FEATURES)] == [44, 30, 25, 27]


def test_feature_table(built):
    # 25 raw columns, 50 derived ones and the reading's own key.
    assert len(built.columns) == 76 and built.count() == 1000
    nulls = built.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in built.columns]).first()
    assert sum(nulls) == 0


def test_block_length_does_not_change_features(spark, sf, built):
    other = preprocess.build_features(gappy(spark, sf), block_rows=5000)
    cols = ["reading_id", "load_lag_24h", "risk_roll_max_24h", "total_load_mw", "temperature", "region_enc", "load_ratio"]
    assert built.select(cols).exceptAll(other.select(cols)).count() == 0


def test_processed_sink_and_profile(spark, sf, folder):
    profile = preprocess.run(readings(spark, sf), f"{folder}/processed", block_rows=300)
    assert profile.count() == 76 and profile.agg(F.sum("missing")).first()[0] == 0
    back = src.load_readings(spark, None, f"{folder}/processed", None)
    assert back.count() == 1000 and {"date", "load_ratio", "power_margin"} <= set(back.columns)


def test_sources_fall_back_in_order(spark, sf, folder):
    raw = readings(spark, sf).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])
    src.write_processed(raw, f"{folder}/raw", "csv")
    back = src.load_readings(spark, "no_such_table", f"{folder}/none", f"{folder}/raw")
    assert back.drop("date", "load_ratio", "power_margin").exceptAll(raw).count() == 0
    with pytest.raises(FileNotFoundError):
        src.load_readings(spark, None, f"{folder}/none", None)
    tables.register(readings(spark, sf))
    assert src.load_readings(spark, "grid_readings").count() == 1000
    with pytest.raises(ValueError):
        tables.run_report(spark, "nothing")
    assert len(tables.run_all_reports(spark)) == 13


def test_dashboard(spark, sf):
    out = dashboard.refresh(readings(spark, sf), region="ASIA")
    assert len(out) == 8 and out["kpis"].first()["n"] == readings(spark, sf).filter("region = 'ASIA'").count()
    assert all(df.count() > 0 for df in out.values())
    empty = dashboard.refresh(readings(spark, sf), region="nowhere")
    assert empty["kpis"].first()["n"] == 0 and empty["blackout_rate"].count() == 0
    assert len(dashboard.exploration(readings(spark, sf))) == 15


def test_missing_features_are_left_out(spark, sf):
    assert feature_matrix(readings(spark, sf), BLACKOUT_FEATURES, "blackout").columns[-1] == "blackout"


def test_comparison_model_files(spark, built, folder):
    out = models.compare_classifiers(built, BLACKOUT_FEATURES, "blackout", "reading_id", 5, 5, names=["logistic_regression", "random_forest"])
    rows = out.results.collect()
    assert [r["f1_score"] for r in rows] == sorted((r["f1_score"] for r in rows), reverse=True)
    assert out.best_name == rows[0]["model"] and out.best_value == rows[0]["f1_score"]
    assert all(r["roc_auc"] > 0.5 for r in rows) and len(rows) == 3
    models.save_comparison(out, f"{folder}/table")
    assert spark.read.option("header", True).csv(f"{folder}/table").count() == 3
    scaled = models.train(built, ["temperature", "total_load_mw"], "blackout", models.classifier_presets(2, 1000)["logistic_regression"], "lr")
    for name, model in (("best", out.best), ("scaled", scaled)):
        models.save_model(model, f"{folder}/{name}", {"f1_score": out.best_value})
        loaded, about = models.load_model(spark, f"{folder}/{name}")
        assert about == {"f1_score": out.best_value}
        a = model.predict(built).select("reading_id", F.round("score", 9).alias("s"))
        b = loaded.predict(built).select("reading_id", F.round("score", 9).alias("s"))
        assert a.exceptAll(b).count() == 0
    importance = models.feature_importance(out.best, spark, 20).collect()
    assert 0 < len(importance) <= 20


def test_demand_job(built):
    out = models.compare_regressors(built, DEMAND_FEATURES, "total_load_mw", "datetime", "reading_id", 5, names=["ridge", "random_forest_reg"])
    assert out.results.count() == 2 and out.best_value == out.results.first()["rmse"]


def test_stream_equals_batch(spark, sf, folder):
    df = readings(spark, sf)
    df.repartition(6).write.parquet(f"{folder}/in")
    stream = score.read_stream(spark, f"{folder}/in", df.schema, files_per_batch=2)
    query = score.write_stream(score.score_stream(stream), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    want = score.score_stream(df)
    assert got.count() == 1000 and got.select(want.columns).exceptAll(want).count() == 0
