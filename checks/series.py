"""Time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, even, readings, with_sql
from gridloom.functions.rounding import half_even
from gridloom.operators import series as S

_CUT = {"hour": "date_trunc('hour', datetime)", "day": "date_trunc('day', datetime)",
        "week": "date_trunc('week', datetime) + interval 6 day"}


def _r(df, *columns):
    return df.withColumns({c: half_even(F.col(c), 6) for c in columns})


for _freq in ("hour", "day", "week"):
    @check(f"g39_resample_{_freq}", with_sql(f"""
select 'All' as series_key, cast({_CUT[_freq]} as timestamp) as ts, {even('avg(total_load_mw)')} as value from grid_readings group by 2"""))
    def _(spark, sf, freq=_freq):
        return _r(S.resample(readings(spark, sf), "total_load_mw", freq=freq, gaps=False), "value")


# Half of the hours of each region are missing from this view.
def _sparse(spark, sf):
    df = readings(spark, sf)
    return df.filter((F.col("hour") * 7 + F.dayofmonth("datetime")) % 3 != 0)


_SPARSE = "select * from grid_readings where (hour*7 + day(datetime)) % 3 <> 0"
_SERIES = {
    "means": "select region as series_key, date_trunc('hour', datetime)::timestamp as ts, avg(total_load_mw) as v from {src} group by 1, 2",
    "spine": """select series_key, unnest(generate_series(a, b, interval 1 hour))::timestamp as ts
      from (select series_key, min(ts) as a, max(ts) as b from means group by 1)""",
    "gaps": "select spine.series_key, spine.ts, v, row_number() over (partition by spine.series_key order by spine.ts) as i from spine left join means on spine.series_key = means.series_key and spine.ts = means.ts",
    "near": """select *, last_value(v ignore nulls) over w0 as v0, last_value(case when v is not null then i end ignore nulls) over w0 as i0,
      first_value(v ignore nulls) over w1 as v1, first_value(case when v is not null then i end ignore nulls) over w1 as i1 from gaps
      window w0 as (partition by series_key order by ts rows between unbounded preceding and current row),
      w1 as (partition by series_key order by ts rows between current row and unbounded following)""",
    "series": "select series_key, ts, coalesce(v, v0 + (v1-v0)*(i-i0)::double/(i1-i0), v0) as value from near",
}


def _with_series(body: str, sparse: bool = False, **more: str) -> str:
    ctes = {k: v.replace("{src}", "sparse" if sparse else "grid_readings") for k, v in _SERIES.items()}
    return with_sql(body, **({"sparse": _SPARSE} if sparse else {}), **ctes, **more)


@check("j02_time_spine", _with_series(f"select series_key, ts, {even('v')} as value from gaps", sparse=True))
def _(spark, sf):
    return _r(S.resample(_sparse(spark, sf), "total_load_mw", key="region"), "value")


@check("w09_position_interpolation", _with_series(f"select series_key, ts, {even('value')} as value from series", sparse=True))
def _(spark, sf):
    return _r(S.interpolate(S.resample(_sparse(spark, sf), "total_load_mw", key="region")), "value")


@check("t01_prepare_series", _with_series(f"select series_key, ts, {even('value')} as value from series"))
def _(spark, sf):
    return _r(S.prepare_series(readings(spark, sf), key="region"), "value")


_DECOMPOSE = {
    "pos": "select *, row_number() over w - 1 as i, count(*) over (partition by series_key) as n from series window w as (partition by series_key order by ts)",
    "ma": """select *, case when i >= 12 and i < n - 12 then (sum(value) over (partition by series_key order by ts rows between 12 preceding and 11 following)
      + sum(value) over (partition by series_key order by ts rows between 11 preceding and 12 following))/48 end as t from pos""",
    "fit": """select series_key, regr_slope(t, i) filter (i >= 12 and i < 36) as k0, regr_intercept(t, i) filter (i >= 12 and i < 36) as c0,
      regr_slope(t, i) filter (i >= n - 36 and i < n - 12) as k1, regr_intercept(t, i) filter (i >= n - 36 and i < n - 12) as c1 from ma group by 1""",
    "tr": "select ma.*, coalesce(t, case when i < 12 then c0 + k0*i else c1 + k1*i end) as trend from ma join fit using (series_key)",
    "ph": "select series_key, i % 24 as p, avg(value - trend) as s from tr group by 1, 2",
    "sea": "select series_key, p, s - avg(s) over (partition by series_key) as seasonal from ph",
    "parts": "select tr.series_key, ts, value, i, n, trend, seasonal from tr join sea on tr.series_key = sea.series_key and tr.i % 24 = sea.p",
}


@check("t03_decompose", _with_series(
    f"select series_key, ts, {even('value')} as observed, {even('trend')} as trend, {even('seasonal')} as seasonal, {even('value - trend - seasonal')} as residual from parts",
    **_DECOMPOSE))
def _(spark, sf):
    return _r(S.decompose(S.prepare_series(readings(spark, sf), key="region")), "observed", "trend", "seasonal", "residual")


@check("t07_load_peaks", _with_series(f"""
select s.series_key, ts, {even('value')} as value, {even('threshold')} as threshold from series s
join (select series_key, quantile_cont(value, 0.95) as threshold from series group by 1) q using (series_key) where value > threshold"""))
def _(spark, sf):
    return _r(S.load_peaks(S.prepare_series(readings(spark, sf), key="region")), "value", "threshold")


@check("t08_trend_statistics", _with_series(f"""
select series_key, {even('avg(trend)', 2)} as mean, {even('stddev_samp(trend)', 2)} as std, {even('min(trend)', 2)} as "min", {even('max(trend)', 2)} as "max",
  {even('(arg_max(trend, ts) - arg_min(trend, ts))/(count(*)/24.0::double)', 4)} as slope_mw_day from parts group by 1""", **_DECOMPOSE))
def _(spark, sf):
    return S.trend_statistics(S.prepare_series(readings(spark, sf), key="region"))


@check("w07_smooth_daily", with_sql(f"""
select 'All' as series_key, ts, {even('v')} as value, case when count(*) over w = 7 then {even('avg(v) over w')} end as rolled
from (select date_trunc('day', datetime)::timestamp as ts, avg(total_load_mw) as v from grid_readings group by 1)
window w as (order by ts rows between 6 preceding and current row)"""))
def _(spark, sf):
    return _r(S.smooth(S.resample(readings(spark, sf), "total_load_mw", freq="day", gaps=False)), "value", "rolled")


@check("o07_hold_out", _with_series("""
select series_key, ts, case when row_number() over (partition by series_key order by ts desc) <= 48 then 'test' else 'train' end as part from series"""))
def _(spark, sf):
    train, test = S.split_last(S.prepare_series(readings(spark, sf), key="region"), 48)
    return train.select("series_key", "ts", F.lit("train").alias("part")).unionByName(test.select("series_key", "ts", F.lit("test").alias("part")))


@check("t02_stationarity")
def _(spark, sf):
    return S.stationarity(S.prepare_series(readings(spark, sf), key="region"))


@check("t04_seasonal_forecast")
def _(spark, sf):
    train, test = S.split_last(S.prepare_series(readings(spark, sf)), 48)
    return S.seasonal_forecast(train, test)


@check("t04_seasonal_report")
def _(spark, sf):
    train, test = S.split_last(S.prepare_series(readings(spark, sf), key="region"), 48)
    return S.seasonal_report(train, test)


@check("t05_window_forecast")
def _(spark, sf):
    train, test = S.split_last(S.prepare_series(readings(spark, sf), key="region"), 48)
    return S.window_forecast(train, test)


@check("t05_window_forecast_metrics")
def _(spark, sf):
    train, test = S.split_last(S.prepare_series(readings(spark, sf), key="region"), 48)
    return S.forecast_metrics(test, S.window_forecast(train, test))


@check("t06_forecast_by_region")
def _(spark, sf):
    train, test, forecast = S.forecast_by_key(readings(spark, sf), "region")
    return S.forecast_metrics(test, forecast)


@check("t09_forecast_table")
def _(spark, sf):
    train, test, forecast = S.forecast_by_key(readings(spark, sf), "region")
    return S.forecast_table(train, test, forecast)
