"""Dashboard tables from the stored cube; each must equal the SQL over the readings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import SQL, check, even, readings, with_sql
from checks.tables import _KPI
from gridloom.functions.rounding import half_even
from gridloom.plans import cube

_BUILT: dict[tuple[str, str], object] = {}


def _cube(spark, sf):
    """The cube of the readings, written once per application and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _BUILT:
        _BUILT[at] = cube.build(readings(spark, sf))
    return _BUILT[at]


#: Table of the refresh and the registered query over the readings that it must equal.
_SAME = {
    "blackout_rate": "g20_blackout_rate_by_region", "load_heatmap": "g29_hour_weekday_load", "load_by_hour": "g21_mean_load_by_hour",
    "load_by_month": "g24_load_by_month", "risk_by_hour": "g23_risk_by_hour", "risk_by_season": "g22_mean_risk_by_season",
    "risk_by_event": "g22_mean_risk_by_event", "shedding_by_region": "g25_shedding_by_region", "events": "g26_event_statistics",
}

for _name, _like in _SAME.items():
    @check(f"cube_{_name}", SQL[_like])
    def _(spark, sf, name=_name):
        return cube.refresh(_cube(spark, sf))[name]


@check("cube_kpis", with_sql(
    f"select {_KPI} from grid_readings where region = 'ASIA' and season = 'S2' and datetime >= '2024-01-05' and datetime < '2024-01-21'"))
def _(spark, sf):
    chosen = dict(region="ASIA", season="S2", start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 20))
    return cube.refresh(_cube(spark, sf), **chosen)["kpis"]


def _spine_sql(measure: str, day: str, step: int) -> str:
    return with_sql(f"""
select 'All' as series_key, cast(s.t as timestamp) as ts, m.value from
  (select unnest(generate_series(min(t), max(t), interval {step} day)) as t from means) s left join means m on m.t = s.t""",
        means=f"select cast({day} as timestamp) as t, {even(f'avg({measure})')} as value from grid_readings where city <> 'CHINA' group by 1")


for _name, _measure, _day, _step in (
    ("daily_load", "total_load_mw", "datetime::date", 1),
    ("weekly_price", "energy_price", "datetime::date + cast(7 - isodow(datetime) as int)", 7),
):
    @check(f"cube_{_name}", _spine_sql(_measure, _day, _step))
    def _(spark, sf, name=_name):
        out = cube.refresh(_cube(spark, sf).filter("city <> 'CHINA'"))[name]
        return out.withColumn("value", half_even(F.col("value"), 6))
