"""Named reports and catalog objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.base import check, readings, table, total, up, with_sql
from gridloom.operators import reports as R
from gridloom.sources import tables


def _avg(column: str, name: str, digits: int = 2) -> str:
    return f"{up(f'avg({column})', digits)} as {name}"


def _pct(flag: str, name: str) -> str:
    return f"{up(f'100.0::double*sum({flag})/count(*)')} as {name}"


def _report(key: str, fn, sql: str) -> None:
    check(key, with_sql(sql))(lambda spark, sf: fn(readings(spark, sf)))


_report("g01_overview", R.overview, f"""
select count(*) as total_readings, {total('blackout')} as total_blackouts, {total('overload')} as total_overloads,
  {_avg('total_load_mw', 'avg_load_mw')}, {_avg('outage_risk', 'avg_outage_risk')},
  {_avg('load_shedding_mw', 'avg_shedding_mw')}, min(datetime) as period_start, max(datetime) as period_end
from grid_readings""")

_report("g02_blackout_by_region", R.blackout_by_region, f"""
select region, count(*) as total, {total('blackout')} as blackouts, {_pct('blackout', 'blackout_rate_pct')},
  {_avg('outage_risk', 'avg_risk')}, {_avg('load_shedding_mw', 'avg_shedding')}
from grid_readings group by region""")

_report("g03_blackout_by_hour", R.blackout_by_hour, f"""
select hour, count(*) as total, {total('blackout')} as blackouts, {_pct('blackout', 'blackout_rate_pct')},
  {_avg('total_load_mw', 'avg_load')}, {_avg('outage_risk', 'avg_risk')}
from grid_readings group by hour""")

_report("g04_monthly_summary", R.monthly_summary, f"""
select strftime(datetime, '%Y-%m') as month, count(*) as readings, {total('blackout')} as blackouts,
  {total('overload')} as overloads, {_avg('total_load_mw', 'avg_load_mw')}, {_avg('available_power_mw', 'avg_available_mw')},
  {_avg('outage_risk', 'avg_risk')}, {up('sum(load_shedding_mw)')} as total_shedding_mw,
  {_avg('temperature', 'avg_temp')}, {_avg('energy_price', 'avg_price')}
from grid_readings group by 1""")

_report("g05_top_risk_periods", R.top_risk_periods, """
select datetime, region, city, outage_risk, total_load_mw, available_power_mw, load_shedding_mw, event, temperature, voltage
from grid_readings where outage_risk > 90
order by outage_risk desc, datetime, region, city, total_load_mw limit 50""")

_report("g06_event_impact", R.event_impact, f"""
select event, count(*) as occurrences, {_avg('total_load_mw', 'avg_load_mw')}, {_avg('outage_risk', 'avg_risk')},
  {total('blackout')} as blackouts, {_pct('blackout', 'blackout_rate_pct')}, {_avg('load_shedding_mw', 'avg_shedding')}
from grid_readings group by event""")

_report("g07_peak_load_analysis", R.peak_load_analysis, """
select region, city, datetime, total_load_mw, available_power_mw, outage_risk, event, temperature
from grid_readings
qualify row_number() over (partition by region order by total_load_mw desc, datetime, city) <= 5""")

_report("g08_power_deficit_windows", R.power_deficit_windows, f"""
select datetime, region, city, total_load_mw, available_power_mw, {up('total_load_mw - available_power_mw')} as deficit_mw,
  outage_risk, blackout, load_shedding_mw
from grid_readings where total_load_mw > available_power_mw
order by deficit_mw desc, datetime, region, city limit 100""")

_report("g09_transformer_stress", R.transformer_stress, f"""
select region, city, {_avg('transformer_temp', 'avg_temp')}, max(transformer_temp) as max_temp, {_avg('voltage', 'avg_voltage')},
  {_avg('frequency', 'avg_frequency')}, {total('overload')} as overloads, {total('blackout')} as blackouts
from grid_readings group by region, city""")

_report("g10_season_analysis", R.season_analysis, f"""
select season, count(*) as readings, {_avg('total_load_mw', 'avg_load')}, {_avg('temperature', 'avg_temp')},
  {_avg('humidity', 'avg_humidity')}, {total('blackout')} as blackouts, {total('overload')} as overloads,
  {_avg('renewable_power_mw', 'avg_renewable_mw')}, {_avg('energy_price', 'avg_price')}
from grid_readings group by season""")

_report("g11_city_risk_ranking", R.city_risk_ranking, f"""
select city, region, count(*) as total, {total('blackout')} as blackouts, {total('overload')} as overloads,
  {_avg('outage_risk', 'avg_risk')}, {up('max(outage_risk)')} as max_risk, {_avg('load_shedding_mw', 'avg_shedding')},
  {_avg('population_density', 'avg_pop_density', 0)}
from grid_readings group by city, region""")

_report("g12_hourly_load_window", R.hourly_load_window, f"""
select hour, {up('m')} as avg_load,
  {up('avg(m) over (order by hour rows between 2 preceding and 2 following)')} as smoothed_load,
  {up('hi')} as max_load, {up('lo')} as min_load, blackouts
from (select hour, avg(total_load_mw) as m, max(total_load_mw) as hi, min(total_load_mw) as lo,
        {total('blackout')} as blackouts from grid_readings group by hour)""")

_report("g13_renewable_contribution", R.renewable_contribution, f"""
select strftime(datetime, '%Y-%m') as month, region, {_avg('renewable_power_mw', 'avg_renewable')},
  {_avg('available_power_mw', 'avg_available')},
  {up('100.0::double*avg(renewable_power_mw)/nullif(avg(available_power_mw),0)')} as renewable_pct
from grid_readings group by 1, region""")

_report("g14_transformer_adhoc", R.transformer_report, f"""
select region, city, {_avg('transformer_temp', 'avg_temp')}, max(transformer_temp) as max_temp, {_avg('voltage', 'avg_voltage')},
  {total('blackout')} as blackouts, {total('overload')} as overloads, count(*) as observations,
  {_pct('blackout', 'blackout_rate_pct')}
from grid_readings where transformer_temp is not null group by region, city having count(*) > 100
order by avg_temp desc, region, city limit 15""")


# Orders span seven years and many rows share a day: the month tests need both.
def _orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderdate").alias("datetime"), F.col("o_orderstatus").alias("region"),
        F.col("o_totalprice").alias("total_load_mw"), (F.col("o_totalprice") * 2).alias("available_power_mw"),
        (F.col("o_orderkey") % 101).cast("double").alias("outage_risk"),
        (F.col("o_orderkey") % 60).cast("double").alias("renewable_power_mw"),
        (F.col("o_orderkey") % 7).cast("double").alias("load_shedding_mw"),
        (F.col("o_custkey") % 40).cast("double").alias("temperature"),
        (F.col("o_custkey") % 13).cast("double").alias("energy_price"),
        (F.col("o_orderkey") % 2).cast("int").alias("blackout"), (F.col("o_orderkey") % 3).cast("int").alias("overload"),
    )


_ORDERS = """with grid_readings as (select o_orderdate as datetime, o_orderstatus as region, o_totalprice as total_load_mw,
  o_totalprice*2 as available_power_mw, cast(o_orderkey%101 as double) as outage_risk,
  cast(o_orderkey%60 as double) as renewable_power_mw, cast(o_orderkey%7 as double) as load_shedding_mw,
  cast(o_custkey%40 as double) as temperature, cast(o_custkey%13 as double) as energy_price,
  cast(o_orderkey%2 as int) as blackout, cast(o_orderkey%3 as int) as overload from orders)
"""


@check("g04_monthly_summary_orders", _ORDERS + f"""
select strftime(datetime, '%Y-%m') as month, count(*) as readings, {total('blackout')} as blackouts,
  {total('overload')} as overloads, {_avg('total_load_mw', 'avg_load_mw')}, {_avg('available_power_mw', 'avg_available_mw')},
  {_avg('outage_risk', 'avg_risk')}, {up('sum(load_shedding_mw)')} as total_shedding_mw,
  {_avg('temperature', 'avg_temp')}, {_avg('energy_price', 'avg_price')}
from grid_readings group by 1""")
def _(spark, sf):
    return R.monthly_summary(_orders(spark, sf))


@check("g13_renewable_contribution_orders", _ORDERS + f"""
select strftime(datetime, '%Y-%m') as month, region, {_avg('renewable_power_mw', 'avg_renewable')},
  {_avg('available_power_mw', 'avg_available')},
  {up('100.0::double*avg(renewable_power_mw)/nullif(avg(available_power_mw),0)')} as renewable_pct
from grid_readings group by 1, region""")
def _(spark, sf):
    return R.renewable_contribution(_orders(spark, sf))


@check("s05_blackout_events", with_sql("""
select datetime, region, city, total_load_mw, available_power_mw, outage_risk, load_shedding_mw, event, temperature
from grid_readings where blackout = 1"""))
def _(spark, sf):
    tables.register(readings(spark, sf))
    return spark.table("v_blackout_events")


@check("s06_overload_events", with_sql("""
select datetime, region, city, total_load_mw, available_power_mw,
  total_load_mw / nullif(available_power_mw, 0) as load_ratio, transformer_temp, voltage, frequency, event
from grid_readings where overload = 1"""))
def _(spark, sf):
    tables.register(readings(spark, sf))
    return spark.table("v_overload_events")


@check("s07_listing", with_sql("""
select 'grid_readings' as name, count(*) as n from grid_readings union all
select 'v_blackout_events', count(*) from grid_readings where blackout = 1 union all
select 'v_overload_events', count(*) from grid_readings where overload = 1"""))
def _(spark, sf):
    """The tables of the listing that were not there before, and the rows each holds."""
    for name in ("grid_readings", "v_blackout_events", "v_overload_events"):
        spark.catalog.dropTempView(name)
    before = {r["name"] for r in tables.listing(spark).collect()}
    tables.register(readings(spark, sf))
    new = [r["name"] for r in tables.listing(spark).collect() if r["name"] not in before]
    counts = [spark.table(name).select(F.lit(name).alias("name")).groupBy("name").count().withColumnRenamed("count", "n") for name in new]
    return reduce(lambda a, b: a.unionByName(b), counts)


@check("s10_named_report", with_sql(f"""
select season, count(*) as readings, {_avg('total_load_mw', 'avg_load')}, {_avg('temperature', 'avg_temp')},
  {_avg('humidity', 'avg_humidity')}, {total('blackout')} as blackouts, {total('overload')} as overloads,
  {_avg('renewable_power_mw', 'avg_renewable_mw')}, {_avg('energy_price', 'avg_price')}
from grid_readings group by season"""))
def _(spark, sf):
    tables.register(readings(spark, sf))
    return tables.run_all_reports(spark)["season_analysis"]


@check("s10_adhoc_sql", with_sql("""
select region, season, count(*) as n, max(outage_risk) as max_risk from grid_readings group by region, season"""))
def _(spark, sf):
    tables.register(readings(spark, sf))
    return tables.run_sql(
        spark, "select region, season, count(*) as n, max(outage_risk) as max_risk from grid_readings group by region, season"
    )
