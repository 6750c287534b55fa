"""Sources, sinks, the feature table and the scoring stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import check, even, readings, table, with_sql
from checks.features import ENERGY_CTES, SCORE_CTES, _exact
from gridloom.functions.rounding import half_even
from gridloom.plans import dashboard
from gridloom.plans.preprocess import build_features
from gridloom.schema import RAW_SCHEMA
from gridloom.session import scratch_root
from gridloom.sources import readings as src
from gridloom.streaming import score

_RAW = ", ".join(
    f"cast({f.name} as double) as {f.name}" if f.dataType.simpleString() == "double" else f.name for f in RAW_SCHEMA.fields
)


def _folder(spark, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/gridloom/{label}-{uuid.uuid4().hex}"


def _raw(spark, sf):
    return readings(spark, sf).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


@check("s01_csv_scan", with_sql(f"select {_RAW} from grid_readings"))
def _(spark, sf):
    path = _folder(spark, "csv")
    src.write_processed(_raw(spark, sf), path, "csv")
    return src.read_csv(spark, path)


@check("s02_source_with_fallback", with_sql(f"""
select {_RAW}, cast(datetime as date) as date, total_load_mw/nullif(available_power_mw, 0) as load_ratio,
  available_power_mw - total_load_mw as power_margin from grid_readings"""))
def _(spark, sf):
    path = _folder(spark, "processed")
    _raw(spark, sf).write.parquet(path)
    return src.load_readings(spark, "no_such_table", path, None)


@check("s03_processed_sink", with_sql("""
select reading_id, total_load_mw, cast(year(datetime) as int) as "year", cast(month(datetime) as int) as "month" from grid_readings"""))
def _(spark, sf):
    path = _folder(spark, "processed")
    df = readings(spark, sf).select(
        "reading_id", "datetime", "city", "region", "total_load_mw", F.year("datetime").alias("year"), F.month("datetime").alias("month"))
    src.write_processed(df, path)
    return spark.read.parquet(path).select("reading_id", "total_load_mw", "year", "month")


@check("s04_persisted_table", with_sql("""
select reading_id, total_load_mw + 1 as total_load_mw, blackout, case when blackout = 1 then reading_id end as blackout_id from grid_readings"""))
def _(spark, sf):
    """The table is written, then read, extended and written again under its own name; its view follows."""
    from gridloom.sources import tables

    name = f"checked_{uuid.uuid4().hex}.grid_readings"
    spark.sql(f"CREATE DATABASE {name.split('.')[0]} LOCATION '{_folder(spark, 'database')}'")
    df = readings(spark, sf)
    tables.register(df.filter("reading_id % 3 > 0"), persist=True, name=name)
    tables.register(spark.table(name).unionByName(df.filter("reading_id % 3 = 0")), persist=True, name=name)
    tables.register(spark.table(name).withColumn("total_load_mw", F.col("total_load_mw") + 1), persist=True, name=name)
    events = spark.table("v_blackout_events").groupBy("datetime", "region", "city", "total_load_mw").agg(F.count("*").alias("n"))
    out = spark.table(name)
    out = out.join(events, ["datetime", "region", "city", "total_load_mw"], "left")
    seen = F.when((F.col("blackout") == 1) & F.col("n").isNotNull(), F.col("reading_id"))
    return out.select("reading_id", "total_load_mw", "blackout", seen.alias("blackout_id"))


@check("s08_comparison_table")
def _(spark, sf):
    """Metrics of two models, written as CSV and read again."""
    from checks.learning import _models, features
    from gridloom.operators import models

    path = _folder(spark, "comparison")
    done = models.compare_classifiers(
        features(spark, sf), models.BLACKOUT_FEATURES, "blackout", "reading_id", names=["logistic_regression", "catboost"], store=_models(spark, sf))
    models.save_comparison(done, path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


@check("s09_stored_model")
def _(spark, sf):
    """A model is stored and loaded; both give each test row the same score."""
    from checks.learning import _models, features
    from gridloom.operators import models
    from gridloom.operators.sampling import stratified_split

    path, rows = _folder(spark, "model"), features(spark, sf)
    best = models.compare_classifiers(rows, models.BLACKOUT_FEATURES, "blackout", "reading_id", names=["catboost"], store=_models(spark, sf)).best
    models.save_model(best, path, {"metric": "f1_score"})
    test = stratified_split(rows, "reading_id", "blackout")[1]
    again, about = models.load_model(spark, path)
    both = best.predict(test).select("reading_id", F.col("score").alias("before")).join(again.predict(test).select("reading_id", "score"), "reading_id")
    return both.select("reading_id", "score", (F.col("score") == F.col("before")).alias("same"), F.lit(about["metric"]).alias("metric"))


def _next(c: str, digits: int = 6) -> str:
    onward = "over (order by datetime, reading_id rows between current row and unbounded following)"
    return f"{even(f'coalesce(first_value({c} ignore nulls) {onward}, 0.0::double)', digits)} as {c}"


_O = "over (order by datetime, reading_id{})"


@check("feature_table", with_sql(f"""
select reading_id, {', '.join(_next(c) for c in ('load_lag_24h', 'outage_risk_lag_1h', 'load_roll_mean_24h', 'risk_roll_max_6h', 'load_ratio', 'grid_stress_index'))},
  cast(dense_rank() over (order by city) - 1 as int) as city_enc, cast(weekofyear(datetime) as int) as "week",
  case when hour in (6,7,8,17,18,19,20,21) then 1 else 0 end as is_peak_hour
from (select *, lag(total_load_mw, 24) {_O.format('')} as load_lag_24h, lag(outage_risk) {_O.format('')} as outage_risk_lag_1h,
  avg(total_load_mw) {_O.format(' rows between 23 preceding and current row')} as load_roll_mean_24h,
  max(outage_risk) {_O.format(' rows between 5 preceding and current row')} as risk_roll_max_6h from features)""", **ENERGY_CTES))
def _(spark, sf):
    out = build_features(readings(spark, sf))
    rounded = ["load_lag_24h", "outage_risk_lag_1h", "load_roll_mean_24h", "risk_roll_max_6h", "load_ratio", "grid_stress_index"]
    return out.select("reading_id", *[half_even(F.col(c), 6).alias(c) for c in rounded], "city_enc", "week", "is_peak_hour")


@check("dashboard_critical", with_sql("""
select cast(datetime as varchar) as datetime, region, city, outage_risk, total_load_mw, available_power_mw, load_shedding_mw, event
from (select * from grid_readings where outage_risk > 90 and region = 'ASIA' order by outage_risk desc, datetime, reading_id limit 20)"""))
def _(spark, sf):
    return dashboard.refresh(readings(spark, sf), region="ASIA")["critical"]


@check("st1_score_stream", with_sql(f"""
select reading_id, cast(risk >= 0.5 as int) as prediction, {_exact('risk*100', 2)} as probability_pct, {_exact('lr', 3)} as load_ratio,
  {_exact('st*100', 2)} as grid_stress_pct, {even('abs(voltage-220)')} as voltage_deviation from p""", **SCORE_CTES))
def _(spark, sf):
    """Events arrive as a stream, meet the static tables, are scored and land in Parquet."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = _folder(spark, "stream")
    query = score.write_stream(score.score_stream(readings(spark, sf, events)), f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(
        "reading_id", "prediction", "probability_pct", "load_ratio", "grid_stress_pct",
        half_even(F.col("voltage_deviation"), 6).alias("voltage_deviation"))
