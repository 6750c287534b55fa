import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar, risk
from gridloom.functions.risk import with_risk_score
from gridloom.operators import aggregates, clean, filters, reports, series

SCENARIOS = [
    ("quiet night", 120, 350, 45, 222, 50.1, 10, "No Event", 18.14, "FAIBLE", 0.343, 19.36),
    ("normal morning", 280, 350, 65, 219, 49.9, 35, "No Event", 39.0, "MODERE", 0.8, 33.13),
    ("evening peak", 380, 350, 88, 212, 49.5, 72, "No Event", 62.33, "ELEVE", 1.086, 49.21),
    ("football match", 440, 350, 95, 208, 49.2, 88, "Football", 83.96, "CRITIQUE", 1.257, 57.39),
    ("critical overload", 520, 350, 110, 198, 48.8, 95, "Festival", 96.12, "CRITIQUE", 1.486, 71.46),
    ("single", 420, 360, 92, 208, 49.5, 85, "Football Match", 79.83, "CRITIQUE", 1.167, 53.33),
]


def test_score_scenarios(spark):
    rows = [tuple(float(v) if isinstance(v, int) else v for v in s[:8]) for s in SCENARIOS]
    df = spark.createDataFrame(rows, "name string, total_load_mw double, available_power_mw double, transformer_temp double, "
                               "voltage double, frequency double, outage_risk double, event string")
    got = {r["name"]: r for r in with_risk_score(df).collect()}
    for name, *_, pct, level, ratio, stress in SCENARIOS:
        r = got[name]
        assert (r["probability_pct"], r["risk_level"], r["load_ratio"], r["grid_stress_pct"]) == (pct, level, ratio, stress)
        assert r["prediction"] == int(pct >= 50)


def test_score_defaults(spark):
    df = spark.createDataFrame([(0.0, 0.0, 60.0, 220.0, 50.0)], "total_load_mw double, available_power_mw double, transformer_temp double, voltage double, frequency double")
    r = with_risk_score(df).first()
    assert r["load_ratio"] == 0.0 and r["probability_pct"] == pytest.approx(17.5 + 3.0 + 7.5)


def test_right_closed_labels(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 30, 31, 100, 101)], "x double")
    assert [r[0] for r in df.select(risk.risk_label(F.col("x"))).collect()] == [None, "Faible", "Faible", "Modéré", "Critique", None]


def test_hours_outside_the_day(spark):
    df = spark.createDataFrame([(24,), (-1,), (0,), (23,)], "h int")
    assert [r[0] for r in df.select(calendar.time_of_day(F.col("h"))).collect()] == ["nan", "nan", "Nuit", "Nuit tardive"]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert clean.fill_mode(df, ["c"]).filter("c = 'a'").count() == 3


def test_duplicates_and_names(spark):
    df = spark.createDataFrame([(1, " x "), (1, " x ")], "` Reading Id` int, Region string")
    out = clean.clean_basic(df)
    assert out.columns == ["reading_id", "region"] and out.collect() == [(1, "x")]


def test_end_date(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2),), (dt.datetime(2024, 1, 2, 5),), (dt.datetime(2024, 1, 3),)], "datetime timestamp_ntz")
    end = dt.date(2024, 1, 2)
    assert filters.select_readings(df, end=end).count() == 2
    assert filters.select_readings(df, end=end, literal_end=True).count() == 1


def test_clip_only_where_an_outlier_exists(spark):
    inside = [(float(v),) for v in range(0, 60)]
    df = spark.createDataFrame(inside, "temperature double")
    assert clean.clip_outliers(df).agg(F.min("temperature")).first()[0] == 0.0
    wild = spark.createDataFrame(inside + [(500.0,), (None,)], "temperature double")
    row = clean.clip_outliers(wild).agg(F.min("temperature"), F.max("temperature"), F.count("*"), F.count("temperature")).first()
    assert tuple(row) == (15.0, 50.0, 62, 61)


def test_pivot_has_seven_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), 3, 1.0), (dt.datetime(2024, 1, 2, 3), 3, 2.0)], "datetime timestamp_ntz, hour int, total_load_mw double")
    row = aggregates.hour_weekday_load(df).first()
    assert len(row) == 8 and sum(v is None for v in row) == 5


def test_week_is_named_by_its_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 7, 23), 3.0), (dt.datetime(2024, 1, 8), 5.0)], "datetime timestamp_ntz, v double")
    got = [(r["ts"].date().isoformat(), r["value"]) for r in series.resample(df, "v", freq="week").orderBy("ts").collect()]
    assert got == [("2024-01-07", 2.0), ("2024-01-14", 5.0)]


def test_position_interpolation(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), v) for h, v in enumerate([1.0, None, None, 4.0, None])]
    df = spark.createDataFrame(rows, "series_key string, ts timestamp_ntz, value double")
    assert [r["value"] for r in series.interpolate(df).orderBy("ts").collect()] == [1.0, 2.0, 3.0, 4.0, 4.0]


def test_same_month_of_two_years_stays_apart(spark):
    rows = [(dt.datetime(y, 1, 5), "r", 1.0, 0.0, y) for y in (2022, 2023)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, region string, renewable_power_mw double, available_power_mw double, month int")
    out = reports.renewable_contribution(df).collect()
    assert [r["month"] for r in out] == ["2022-01", "2023-01"] and out[0]["renewable_pct"] is None


def test_histogram_of_one_value(spark):
    out = aggregates.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 10).collect()
    assert len(out) == 1 and out[0]["n"] == 2


def test_histogram_bins_as_sql_rounds(spark):
    """58 of 0 to 100 in 50 bins: its share of the range, times the bins, stays under 29; bins times value, divided, does not."""
    values = [i / 100 for i in range(10001)]
    got = aggregates.histogram(spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, s int"), "x", 50, "s").collect()
    want = Counter((min(math.floor(v / 100 * 50) + 1, 50), i % 2) for i, v in enumerate(values))
    assert {(r["bin"], r["s"]): r["n"] for r in got} == want
    assert [(r["bin"], r["s"]) for r in got] == sorted(want)


def test_rounding_sites(spark):
    from gridloom.functions.rounding import half_even, half_up

    df = spark.createDataFrame([(0.125,), (1.005,)], "x double")
    assert [tuple(r) for r in df.select(half_up(F.col("x"), 2), half_even(F.col("x"), 2)).collect()] == [(0.13, 0.12), (1.01, 1.0)]


@pytest.mark.parametrize("listed,small", [(200, 50_000), (1, 50_000), (1, 1)])
def test_label_codes_do_not_depend_on_the_path(spark, monkeypatch, listed, small):
    from gridloom.operators import encode

    monkeypatch.setattr(encode, "LISTED_CLASSES", listed)
    monkeypatch.setattr(encode, "SMALL_DICTIONARY", small)
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, None, "x"), (4, "z", "x")], "id int, city string, season string")
    out = encode.label_encode(df).orderBy("id").collect()
    assert [(r["city_enc"], r["season_enc"]) for r in out] == [(1, 0), (0, 0), (2, 0), (3, 0)]
