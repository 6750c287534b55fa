import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import series
from gridloom.plans import cube

_SCHEMA = ("id int, datetime timestamp_ntz, hour int, region string, city string, season string, event string, "
           "total_load_mw double, outage_risk double, blackout int, overload int, load_shedding_mw double, energy_price double")


def _rows(n):
    out = []
    for i in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 7 % 900 if i % 3 else 5)  # a third of all rows in one hour
        out.append((
            i, at, at.hour, None if i % 11 == 0 else f"r{i % 3}", f"c{i % 7}", f"s{i % 2}", None if i % 13 == 0 else f"e{i % 4}",
            None if i % 17 == 0 else i * 0.37 % 50, i * 1.3 % 100, i % 5 // 4, None if i % 19 == 0 else i % 2, i * 0.11, 3.0 + i % 9))
    return out


def _same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("choices", [{}, {"region": "r1", "start": dt.date(2024, 1, 3), "end": dt.date(2024, 1, 20)}, {"city": "none"}])
def test_tables_equal_those_of_the_readings(spark, choices):
    from gridloom.operators.filters import select_readings

    df = spark.createDataFrame(_rows(600), _SCHEMA).repartition(4)
    part, built = select_readings(df, **choices), cube.build(df)
    got = cube.refresh(built, **choices)
    want = {
        "kpis": A.kpi_row(part), "blackout_rate": A.rate_by(part, "region", "blackout"), "load_heatmap": A.hour_weekday_load(part),
        "load_by_hour": A.mean_by(part, "hour", "total_load_mw"), "load_by_month": A.load_by_month(part), "risk_by_hour": A.risk_by_hour(part),
        "risk_by_season": A.mean_by(part, "season", "outage_risk"), "risk_by_event": A.mean_by(part, "event", "outage_risk"),
        "shedding_by_region": A.total_by(part, "region", "load_shedding_mw"), "events": A.event_statistics(part),
    }
    for name, table in want.items():
        assert _same(got[name], table), name
    for name, measure, freq in (("daily_load", "total_load_mw", "day"), ("weekly_price", "energy_price", "week")):
        rounded = [t.withColumn("value", F.round("value", 9)) for t in (got[name], series.resample(part, measure, freq=freq))]
        assert _same(*rounded), name
    assert set(got) == {*want, "daily_load", "weekly_price"}


def test_tables_read_the_cube_only_and_missing_measures(spark, tmp_path):
    path = str(tmp_path / "readings")
    spark.createDataFrame(_rows(50), _SCHEMA).drop("energy_price", "outage_risk").write.parquet(path)
    built = cube.build(spark.read.parquet(path))
    got = cube.refresh(built)
    assert set(got) == {"daily_load", "blackout_rate", "load_heatmap", "load_by_hour", "load_by_month", "shedding_by_region"}
    assert all("cube-" in f for table in got.values() for f in table.inputFiles())
    with pytest.raises(ValueError):
        cube.refresh(built, end=dt.date(2024, 1, 2), literal_end=True)
