"""Grouped tables behind the exploration and dashboard views."""

from __future__ import annotations

from checks.base import check, even, readings, total, with_sql
from checks.features import ENERGY_CTES
from gridloom.functions.calendar import with_calendar
from gridloom.functions.energy import with_energy
from gridloom.operators import aggregates as A
from gridloom.operators import filters
from gridloom.schema import CITY_COORDS, CORRELATION_COLUMNS


@check("g20_blackout_rate_by_region", with_sql(
    f"select region, {total('blackout')} as flagged, count(*) as total, {even('sum(blackout)/count(*)::double*100', 2)} as rate_pct from grid_readings group by 1"))
def _(spark, sf):
    return A.rate_by(readings(spark, sf), "region", "blackout")


for _key in ("hour", "region", "season"):
    @check(f"g21_mean_load_by_{_key}", with_sql(f"select {_key}, {even('avg(total_load_mw)')} as mean_total_load_mw from grid_readings group by 1"))
    def _(spark, sf, key=_key):
        return A.mean_by(readings(spark, sf), key, "total_load_mw")


@check("g21_mean_load_by_weekday", with_sql(
    f"select cast(isodow(datetime)-1 as int) as day_of_week, {even('avg(total_load_mw)')} as mean_total_load_mw from grid_readings group by 1"))
def _(spark, sf):
    return A.mean_by(with_calendar(readings(spark, sf)), "day_of_week", "total_load_mw")


for _key in ("season", "event"):
    @check(f"g22_mean_risk_by_{_key}", with_sql(f"select {_key}, {even('avg(outage_risk)')} as mean_outage_risk from grid_readings group by 1"))
    def _(spark, sf, key=_key):
        return A.mean_by(readings(spark, sf), key, "outage_risk")


@check("g23_risk_by_hour", with_sql(
    f"select hour, {even('avg(outage_risk)')} as risk, {total('blackout')} as blackouts from grid_readings group by 1"))
def _(spark, sf):
    return A.risk_by_hour(readings(spark, sf))


@check("g24_load_by_month", with_sql(f"""
select cast(month(datetime) as int) as "month", {even('avg(total_load_mw)')} as mean, max(total_load_mw) as "max", min(total_load_mw) as "min" from grid_readings group by 1"""))
def _(spark, sf):
    return A.load_by_month(readings(spark, sf))


@check("g25_shedding_by_region", with_sql(f"select region, {even('sum(load_shedding_mw)')} as total_load_shedding_mw from grid_readings group by 1"))
def _(spark, sf):
    return A.total_by(readings(spark, sf), "region", "load_shedding_mw")


@check("g26_event_statistics", with_sql(f"""
select event, count(event) as n, {even('avg(total_load_mw)', 2)} as avg_load, {even('avg(outage_risk)', 2)} as avg_risk,
  {even('avg(blackout)', 2)} as blackout_rate, {even('avg(load_shedding_mw)', 2)} as avg_shedding from grid_readings group by 1"""))
def _(spark, sf):
    return A.event_statistics(readings(spark, sf))


@check("g27_region_statistics", with_sql(f"""
select region, {even('avg(outage_risk)')} as avg_risk, {total('blackout')} as blackouts, {total('overload')} as overloads from grid_readings group by 1"""))
def _(spark, sf):
    return A.region_statistics(readings(spark, sf))


_CITY = f"""select city, count(*) as n_readings, {even('avg(blackout)', 3)} as blackout_rate, {even('avg(outage_risk)', 3)} as avg_risk,
  {even('sum(load_shedding_mw)', 3)} as total_shedding, {even('avg(total_load_mw)', 3)} as avg_load, {even('avg(overload)', 3)} as overload_rate,
  {total('blackout')} as n_blackouts from grid_readings group by city"""
_PLACES = ", ".join(f"('{c}', {a}::double, {o}::double)" for c, a, o in CITY_COORDS)
_CITY_PCT = f"""select s.*, {even('blackout_rate*100', 2)} as blackout_pct, {even('overload_rate*100', 2)} as overload_pct,
  coalesce(d.lat, 6.14::double) as lat, coalesce(d.lon, 1.21::double) as lon
from city0 s left join (values {_PLACES}) d(city, lat, lon) on s.city = d.city"""


@check("g28_city_statistics", with_sql("select * from city1", city0=_CITY, city1=_CITY_PCT))
def _(spark, sf):
    return A.city_statistics(readings(spark, sf))


@check("p15_risk_zones", with_sql(f"""
select *, case when avg_risk >= 75 then '#E63946' when avg_risk >= 50 then '#F4A261' when avg_risk >= 30 then '#E9C46A' else '#2A9D8F' end as color,
  case when avg_risk >= 75 then 'CRITIQUE' when avg_risk >= 50 then 'ELEVE' when avg_risk >= 30 then 'MODERE' else 'FAIBLE' end as label,
  {even('10 + avg_risk/6', 3)} as radius from city1""", city0=_CITY, city1=_CITY_PCT))
def _(spark, sf):
    return A.risk_zones(readings(spark, sf))


@check("p16_overload_markers", with_sql("""
select city, lat, lon, overload_pct, n_overloads, case when overload_pct > 15 then 'red' when overload_pct > 8 then 'orange' else 'blue' end as marker
from (select *, cast(trunc(overload_pct*n_readings/100) as bigint) as n_overloads from city1) where n_overloads > 0""", city0=_CITY, city1=_CITY_PCT))
def _(spark, sf):
    return A.overload_markers(readings(spark, sf))


_DAYS = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]


@check("g29_hour_weekday_load", with_sql("select hour, " + ", ".join(
    even(f"avg(total_load_mw) filter (isodow(datetime) = {i + 1})") + f' as "{d}"' for i, d in enumerate(_DAYS)) + " from grid_readings group by hour"))
def _(spark, sf):
    return A.hour_weekday_load(readings(spark, sf))


def _corr_sql(columns) -> str:
    return " union all ".join(
        f"""select '{a}' as "left", '{b}' as "right", {even(f'corr({a}, {b})', 6)} as corr from grid_readings""" for a in columns for b in columns)


for _name, _columns in CORRELATION_COLUMNS.items():
    @check(f"g30_correlations_{_name}", with_sql(_corr_sql(_columns)))
    def _(spark, sf, columns=_columns):
        return A.correlations(readings(spark, sf), list(columns))


@check("g30_ranked_correlations", with_sql(
    'select "left" as "column", corr from (' + _corr_sql(CORRELATION_COLUMNS["explore"]) + """) where "right" = 'blackout' order by corr desc, 1 limit 10"""))
def _(spark, sf):
    return A.ranked_correlations(readings(spark, sf), list(CORRELATION_COLUMNS["explore"]), "blackout")


def _hist_sql(source: str, column: str, bins: int, split: str = "") -> str:
    extra = f", {split}" if split else ""
    return f"""select bin{extra}, count(*) as n, {even(f'any_value(lo) + (bin-1)*((any_value(hi)-any_value(lo))/{bins})')} as bin_from,
  {even(f'any_value(lo) + bin*((any_value(hi)-any_value(lo))/{bins})')} as bin_to
from (select cast(least(floor(({column}-lo)/(hi-lo)*{bins}) + 1, {bins}) as int) as bin{extra}, lo, hi
  from {source}, (select min({column}) as lo, max({column}) as hi from {source}) where {column} is not null) group by bin{extra}"""


@check("g31_histogram", with_sql(_hist_sql("grid_readings", "total_load_mw", 50)))
def _(spark, sf):
    return A.histogram(readings(spark, sf), "total_load_mw", 50)


@check("g31_histogram_split", with_sql(_hist_sql("features", "grid_stress_index", 60, "blackout"), **ENERGY_CTES))
def _(spark, sf):
    return A.histogram(with_energy(readings(spark, sf)), "grid_stress_index", 60, "blackout")


@check("g32_binned_rate", with_sql(f"""
select cast(least(greatest(ceil((grid_stress_index-lo)/((hi-lo)/5)),1),5) as int) as bin, count(*) as n, {even('avg(blackout)*100')} as rate_pct
from features, (select min(grid_stress_index) as lo, max(grid_stress_index) as hi from features) where grid_stress_index is not null group by 1""", **ENERGY_CTES))
def _(spark, sf):
    return A.binned_rate(with_energy(readings(spark, sf)), "grid_stress_index", "blackout")


def _box_sql(source: str, column: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    on = f"x.{by} = l.{by}" if by else "true"
    return f"""select {f'x.{by}, ' if by else ''}'{column}' as "column", count({column}) as n, {even('any_value(q1)')} as q1, {even('any_value(q2)')} as median,
  {even('any_value(q3)')} as q3, {even(f'min({column}) filter ({column} between q1-1.5*(q3-q1) and q3+1.5*(q3-q1))')} as whisker_low,
  {even(f'max({column}) filter ({column} between q1-1.5*(q3-q1) and q3+1.5*(q3-q1))')} as whisker_high,
  count(*) filter (not ({column} between q1-1.5*(q3-q1) and q3+1.5*(q3-q1))) as n_outside
from {source} x join (select {key}quantile_cont({column},0.25) as q1, quantile_cont({column},0.5) as q2, quantile_cont({column},0.75) as q3
  from {source}{f' group by {by}' if by else ''}) l on {on}{f' group by x.{by}' if by else ''}"""


@check("g33_box_by_season", with_sql(_box_sql("grid_readings", "total_load_mw", "season")))
def _(spark, sf):
    return A.box_summary(readings(spark, sf), ["total_load_mw"], ("season",))


@check("g33_box_by_season_narrowing", with_sql(_box_sql("grid_readings", "total_load_mw", "season")))
def _(spark, sf):
    """The same boxes with the many-row quantile path forced for every season."""
    return A.box_summary(readings(spark, sf), ["total_load_mw"], ("season",), in_memory_rows=300)


@check("g33_box_by_peak", with_sql(
    _box_sql("peaks", "total_load_mw", "is_peak_hour"),
    peaks="select *, case when hour in (6,7,8,17,18,19,20,21) then 1 else 0 end as is_peak_hour from grid_readings"))
def _(spark, sf):
    return A.box_summary(with_calendar(readings(spark, sf)), ["total_load_mw"], ("is_peak_hour",))


_BOXES = ["temperature", "total_load_mw", "voltage", "frequency", "transformer_temp"]


@check("g33_box_by_column", with_sql(" union all ".join(_box_sql("grid_readings", c) for c in _BOXES)))
def _(spark, sf):
    return A.box_summary(readings(spark, sf), _BOXES)


@check("g34_marker_quantile", with_sql(f"""
select 'grid_stress_index' as "column", 0.9::double as p, {even('quantile_cont(grid_stress_index, 0.9)')} as value from features""", **ENERGY_CTES))
def _(spark, sf):
    return A.marker_quantile(with_energy(readings(spark, sf)), "grid_stress_index", 0.9)


_KPI = f"""{even('avg(blackout)*100')} as blackout_rate_pct, {even('avg(outage_risk)')} as avg_risk, {even('sum(load_shedding_mw)')} as total_shedding,
  {even('avg(overload)*100')} as overload_rate_pct, {even('avg(total_load_mw)')} as avg_load, {total('blackout')} as blackouts,
  {total('overload')} as overloads, count(*) as n"""


@check("g35_kpi_row", with_sql(f"select {_KPI} from grid_readings where region = 'ASIA'"))
def _(spark, sf):
    return A.kpi_row(filters.select_readings(readings(spark, sf), region="ASIA"))


@check("g35_target_summary", with_sql(f"""
select {total('blackout')} as blackouts, {even('avg(blackout)*100', 2)} as blackout_pct, {total('overload')} as overloads,
  {even('avg(overload)*100', 2)} as overload_pct, {even('avg(outage_risk)', 2)} as avg_risk from grid_readings"""))
def _(spark, sf):
    return A.target_summary(readings(spark, sf))


@check("g36_kpi_delta", with_sql(f"""
select {even('a*100')} as rate_pct, {even('b*100')} as overall_pct, {even('(a-b)*100')} as delta_pct
from (select avg(blackout) as a from grid_readings where region = 'ASIA'), (select avg(blackout) as b from grid_readings)"""))
def _(spark, sf):
    df = readings(spark, sf)
    return A.kpi_delta(filters.select_readings(df, region="ASIA"), df)


def _arg(key: str, value: str) -> str:
    return f"(select {key} from grid_readings group by {key} order by round(avg({value})::decimal(38,9), 9) desc, {key} limit 1)"


@check("g37_project_kpis", with_sql(f"""
select cast(min(datetime) as date) as period_from, cast(max(datetime) as date) as period_to, count(*) as observations,
  {even('avg(blackout)*100')} as blackout_rate_pct, {even('avg(overload)*100')} as overload_rate_pct, {even('sum(load_shedding_mw)')} as total_shedding,
  {even('avg(total_load_mw)')} as avg_load, max(total_load_mw) as max_load, {even('avg(outage_risk)')} as avg_risk,
  {_arg('region', 'outage_risk')} as riskiest_region, {_arg('hour', 'blackout')} as riskiest_hour, {_arg('season', 'blackout')} as riskiest_season,
  cast(26 as bigint) as n_columns from grid_readings"""))
def _(spark, sf):
    return A.project_kpis(readings(spark, sf))


@check("g38_anomaly_rates", with_sql(f"""
select region, {total('overload')} as n_anomalies, count(*) as total, {even('avg(overload)*100', 2)} as rate_pct from grid_readings group by 1"""))
def _(spark, sf):
    return A.anomaly_rates(readings(spark, sf), "overload")
