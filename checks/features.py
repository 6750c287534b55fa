"""Row features, filters, lookups, windows and samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import GAPPY_SQL, check, even, gappy, readings, table, up, with_sql
from gridloom.functions import calendar as cal
from gridloom.functions import energy as en
from gridloom.functions import risk as rk
from gridloom.functions.rounding import half_even
from gridloom.operators import filters as fl
from gridloom.operators import ordered, sampling, windows
from gridloom.operators.encode import feature_matrix, task_features
from gridloom.operators.places import city_dimension, jittered_points, region_dimension, with_coordinates
from gridloom.operators.quantiles import quantiles
from gridloom.schema import CITY_COORDS, DEFAULT_COORDS, TASKS

ORDER = ["datetime", "reading_id"]


def _dates(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("datetime"), (F.col("o_orderkey") % 26 - 1).cast("int").alias("hour"))


_DATES = "select o_orderkey, o_orderdate as datetime, cast(o_orderkey % 26 - 1 as int) as hour from orders"


def _weekday(t: str) -> str:
    return f"(isodow({t}) - 1)"


@check("p01_date_parts", f"""
select o_orderkey, cast(year(datetime) as int) as "year", cast(month(datetime) as int) as "month", cast(day(datetime) as int) as "day",
  cast({_weekday('datetime')} as int) as day_of_week, cast(dayofyear(datetime) as int) as day_of_year, cast(weekofyear(datetime) as int) as "week",
  cast(quarter(datetime) as int) as "quarter", cast({_weekday('datetime')} >= 5 as int) as is_weekend from ({_DATES})""")
def _(spark, sf):
    return _dates(spark, sf).select(
        "o_orderkey", *[e.alias(n) for n, e in cal.date_parts(F.col("datetime")).items()],
        cal.weekend_flag(F.col("datetime")).alias("is_weekend"))


def _cycle(x: str, period: int, name: str) -> str:
    return f"{even(f'sin(2*pi()*{x}/{period})')} as {name}_sin, {even(f'cos(2*pi()*{x}/{period})')} as {name}_cos"


@check("p03_cyclic", f"""select o_orderkey, {_cycle('hour', 24, 'hour')}, {_cycle('month(datetime)', 12, 'month')},
  {_cycle(_weekday('datetime'), 7, 'dow')} from ({_DATES})""")
def _(spark, sf):
    out = cal.with_calendar(_dates(spark, sf))
    return out.select("o_orderkey", *[half_even(F.col(f"{n}_{s}"), 6).alias(f"{n}_{s}")
                                      for n in ("hour", "month", "dow") for s in ("sin", "cos")])


@check("p04_time_of_day", f"""
select o_orderkey, case when hour between 0 and 5 then 'Nuit' when hour between 6 and 11 then 'Matin'
  when hour between 12 and 17 then 'Après-midi' when hour between 18 and 20 then 'Soir'
  when hour between 21 and 23 then 'Nuit tardive' else 'nan' end as time_of_day,
  case when hour in (6,7,8,17,18,19,20,21) then 1 else 0 end as is_peak_hour from ({_DATES})""")
def _(spark, sf):
    return cal.with_calendar(_dates(spark, sf)).select("o_orderkey", "time_of_day", "is_peak_hour")


_ENERGY = """select *, available_power_mw - total_load_mw as power_margin,
  (available_power_mw - total_load_mw)/nullif(available_power_mw,0)*100 as power_margin_pct,
  renewable_power_mw/nullif(available_power_mw,0)*100 as renewable_share,
  industrial_load/nullif(total_load_mw,0) as industrial_share, residential_load/nullif(total_load_mw,0) as residential_share,
  commercial_load/nullif(total_load_mw,0) as commercial_share, total_load_mw/nullif(available_power_mw,0) as load_ratio,
  abs(voltage-220) as voltage_deviation, abs(frequency-50) as frequency_deviation from grid_readings"""
_STRESS = """select *, case when load_ratio is not null then 0.4::double*greatest(least(load_ratio,2.0::double),0.0::double) end
  + 0.3::double*(transformer_temp/100) + 0.15::double*(voltage_deviation/20) + 0.15::double*(frequency_deviation/3) as grid_stress_index from energy"""
ENERGY_CTES = {"energy": _ENERGY, "features": _STRESS}

_P6 = ["power_margin", "power_margin_pct"]
_P7 = ["renewable_share", "industrial_share", "residential_share", "commercial_share"]


def _energy_check(name: str, columns: list[str]) -> None:
    @check(name, with_sql("select reading_id, " + ", ".join(f"{even(c)} as {c}" for c in columns) + " from features", **ENERGY_CTES))
    def _(spark, sf):
        return en.with_energy(readings(spark, sf)).select("reading_id", *[half_even(F.col(c), 6).alias(c) for c in columns])


_energy_check("p06_power_margin", _P6)
_energy_check("p07_shares", _P7)
_energy_check("p08_load_ratio", ["load_ratio"])
_energy_check("p09_deviations", ["voltage_deviation", "frequency_deviation"])
_energy_check("p10_grid_stress_index", ["grid_stress_index"])

_SCORE = {
    "r": "select *, total_load_mw/greatest(available_power_mw,1.0::double) as lr from grid_readings",
    "s": """select *, 0.40::double*least(lr,2.0::double)/2 + 0.30::double*(transformer_temp/120) + 0.15::double*(abs(voltage-220)/40)
      + 0.15::double*(abs(frequency-50)/3) as st from r""",
    "p": """select *, least((outage_risk/100*0.35::double + least(lr,2.0::double)/2*0.30::double + st*0.20::double + transformer_temp/120*0.15::double)
      * case when event is null or event in ('', 'No Event') then 1.0::double else 1.15::double end, 1.0::double) as risk from s""",
}
SCORE_CTES = _SCORE


def _quiet(df):
    return df.withColumn("event", F.when(F.col("event").isin("error", "purchase"), F.col("event")).otherwise("No Event"))


_SCORE_QUIET = dict(
    _SCORE, r="""select * replace (case when event in ('error','purchase') then event else 'No Event' end as event),
  total_load_mw/greatest(available_power_mw,1.0::double) as lr from grid_readings""")


@check("p11_scoring_stress", with_sql(f"select reading_id, {even('lr')} as load_ratio, {even('st')} as stress from s",
                                      r=_SCORE["r"], s=_SCORE["s"]))
def _(spark, sf):
    ratio = rk.floored_ratio(F.col("total_load_mw"), F.col("available_power_mw"))
    stress = rk.scoring_stress(ratio, F.col("transformer_temp"), F.col("voltage"), F.col("frequency"))
    return readings(spark, sf).select("reading_id", half_even(ratio, 6).alias("load_ratio"), half_even(stress, 6).alias("stress"))


def _exact(expr: str, digits: int) -> str:
    """Rounding of a row's own value by its exact binary value."""
    return f"cast(printf('%.{digits}f', {expr}) as double)"


@check("p12_risk_score", with_sql(f"""
select reading_id, cast(risk >= 0.5 as int) as prediction, {_exact('risk*100', 2)} as probability_pct,
  case when risk >= 0.75 then 'CRITIQUE' when risk >= 0.5 then 'ELEVE' when risk >= 0.25 then 'MODERE' else 'FAIBLE' end as risk_level,
  {_exact('lr', 3)} as load_ratio, {_exact('available_power_mw - total_load_mw', 1)} as power_margin_mw,
  {_exact('st*100', 2)} as grid_stress_pct from p""", **_SCORE_QUIET))
def _(spark, sf):
    return rk.with_risk_score(_quiet(readings(spark, sf))).select(
        "reading_id", "prediction", "probability_pct", "risk_level", "load_ratio", "power_margin_mw", "grid_stress_pct")


@check("p14_risk_label", with_sql("""
select reading_id, case when x > -1 and x <= 30 then 'Faible' when x > 30 and x <= 60 then 'Modéré' when x > 60 and x <= 80 then 'Élevé'
  when x > 80 and x <= 100 then 'Critique' end as label,
  case when x > -1 and x <= 30 then 0 when x > 30 and x <= 60 then 1 when x > 60 and x <= 80 then 2 when x > 80 and x <= 100 then 3 end as rank
from (select reading_id, outage_risk*1.1::double - 5 as x from grid_readings)"""))
def _(spark, sf):
    x = F.col("outage_risk") * 1.1 - 5
    return readings(spark, sf).select("reading_id", rk.risk_label(x).alias("label"), rk.risk_rank(x).alias("rank"))


@check("p15_map_classes", with_sql(f"""
select reading_id, case when outage_risk >= 75 then '#E63946' when outage_risk >= 50 then '#F4A261' when outage_risk >= 30 then '#E9C46A' else '#2A9D8F' end as color,
  case when outage_risk >= 75 then 'CRITIQUE' when outage_risk >= 50 then 'ELEVE' when outage_risk >= 30 then 'MODERE' else 'FAIBLE' end as label,
  {even('10 + outage_risk/6')} as radius,
  case when outage_risk < 50 then '#2A9D8F' when outage_risk < 75 then '#E9C46A' else '#E63946' end as scenario_color from grid_readings"""))
def _(spark, sf):
    x = F.col("outage_risk")
    return readings(spark, sf).select(
        "reading_id", rk.map_color(x).alias("color"), rk.map_label(x).alias("label"),
        half_even(rk.map_radius(x), 6).alias("radius"), rk.scenario_color(x).alias("scenario_color"))


@check("p18_year_month", f"select o_orderkey, strftime(datetime, '%Y-%m') as ym, cast(datetime as date) as d, cast(cast(datetime as date) as varchar) as date_text from ({_DATES})")
def _(spark, sf):
    t = F.col("datetime")
    return _dates(spark, sf).select(
        "o_orderkey", cal.year_month(t).alias("ym"), F.to_date(t).alias("d"), F.to_date(t).cast("string").alias("date_text"))


@check("p17_power_deficit", with_sql(f"select reading_id, {up('total_load_mw - available_power_mw')} as deficit_mw from grid_readings"))
def _(spark, sf):
    return readings(spark, sf).select("reading_id", en.deficit().alias("deficit_mw"))


@check("p20_available_columns", with_sql("select temperature, voltage, reading_id as target from grid_readings"))
def _(spark, sf):
    return feature_matrix(readings(spark, sf), ["temperature", "not_there", "voltage"], "reading_id").withColumnRenamed("reading_id", "target")


_RAW_FEATURES = ["temperature", "voltage", "total_load_mw", "outage_risk", "humidity"]


@check("p21_task_features", "select * from (values " + ", ".join(
    f"('{t}', {i}, '{f}', '{y}', '{kind}')" for t, (fs, y, kind) in TASKS.items() for i, f in enumerate(fs)
) + ") x(task, place, feature, target, kind) left join (" + with_sql(
    " union all ".join(f"select '{c}' as feature, count({c}) as known from gappy" for c in _RAW_FEATURES), gappy=GAPPY_SQL) + ") using (feature)")
def _(spark, sf):
    """The features of each task, with the readings that have a value for those that readings hold."""
    known = gappy(spark, sf).agg(*[F.count(c).alias(c) for c in _RAW_FEATURES])
    known = known.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("known")) for c in _RAW_FEATURES])))
    return task_features(spark).join(known, "feature", "left")


@check("p22_rounding", with_sql(
    f"select reading_id, {even('total_load_mw*0.125::double', 2)} as half_even_2, {up('total_load_mw*0.125::double', 2)} as half_up_2 from grid_readings"))
def _(spark, sf):
    from gridloom.functions.rounding import half_up

    x = F.col("total_load_mw") * 0.125
    return readings(spark, sf).select("reading_id", half_even(x, 2).alias("half_even_2"), half_up(x, 2).alias("half_up_2"))


@check("p23_membership_nulls", with_sql(
    "select reading_id, hour in (6,7,8) as early, nullif(available_power_mw, 0) is not null as has_power, nullif(available_power_mw, 0) as power from grid_readings"))
def _(spark, sf):
    power = F.nullif(F.col("available_power_mw"), F.lit(0.0))
    return readings(spark, sf).select("reading_id", F.col("hour").isin(6, 7, 8).alias("early"), power.isNotNull().alias("has_power"), power.alias("power"))


@check("p24_scatter", with_sql("select temperature, total_load_mw, blackout from grid_readings"))
def _(spark, sf):
    from gridloom.operators.aggregates import scatter

    return scatter(readings(spark, sf), "temperature", "total_load_mw")


def _hash(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 13))::bigint"


@check("p24_scatter_sample", with_sql(f"""
select available_power_mw, total_load_mw, blackout, outage_risk from grid_readings order by {_hash('reading_id')}, reading_id limit 3000"""))
def _(spark, sf):
    from gridloom.operators.aggregates import scatter

    sample = sampling.bounded_sample(readings(spark, sf), "reading_id")
    return scatter(sample, "available_power_mw", "total_load_mw", size="outage_risk")


# ------------------------------------------------------------------ filters

@check("f01_select_readings", with_sql("""
select reading_id from grid_readings where region = 'ASIA' and season = 'S2'
  and datetime >= timestamp '2024-01-12' and datetime < timestamp '2024-01-18'"""))
def _(spark, sf):
    return fl.select_readings(readings(spark, sf), region="ASIA", season="S2", start=dt.date(2024, 1, 12), end=dt.date(2024, 1, 17)).select("reading_id")


@check("f01_select_literal_end", with_sql("""
select reading_id from grid_readings where datetime >= timestamp '2024-01-12' and datetime <= timestamp '2024-01-17'"""))
def _(spark, sf):
    return fl.select_readings(readings(spark, sf), start=dt.date(2024, 1, 12), end=dt.date(2024, 1, 17), literal_end=True).select("reading_id")


@check("f02_region_season", with_sql("select reading_id from grid_readings where region = 'EUROPE' and season = 'S1'"))
def _(spark, sf):
    return fl.select_readings(readings(spark, sf), region="EUROPE", season="S1").select("reading_id")


@check("f03_above", with_sql("select reading_id, outage_risk from grid_readings where outage_risk > 90"))
def _(spark, sf):
    return fl.above(readings(spark, sf), "outage_risk", 90).select("reading_id", "outage_risk")


@check("f04_exceeds", with_sql("select reading_id from grid_readings where total_load_mw > available_power_mw"))
def _(spark, sf):
    return fl.exceeds(readings(spark, sf), "total_load_mw", "available_power_mw").select("reading_id")


@check("f05_flagged", with_sql("select reading_id from grid_readings where overload = 1"))
def _(spark, sf):
    return fl.flagged(readings(spark, sf), "overload").select("reading_id")


@check("f06_groups_larger_than", with_sql("select region, city, count(*) as observations from grid_readings group by all having count(*) > 100"))
def _(spark, sf):
    return fl.groups_larger_than(readings(spark, sf), ["region", "city"], 100)


@check("f07_above_quantile", with_sql("""
select reading_id, total_load_mw from grid_readings where total_load_mw > (select quantile_cont(total_load_mw, 0.95) from grid_readings)"""))
def _(spark, sf):
    df = readings(spark, sf)
    cut = quantiles(df, ["total_load_mw"], [0.95]).select(F.col("quantiles")[0]).scalar()
    return df.filter(F.col("total_load_mw") > cut).select("reading_id", "total_load_mw")


@check("f08_long_enough", with_sql("select reading_id, city from grid_readings where city in (select city from grid_readings group by city having count(*) >= 400)"))
def _(spark, sf):
    return fl.long_enough(readings(spark, sf), "city", 400).select("reading_id", "city")


# ------------------------------------------------------------------ lookups

_CITY_VALUES = ", ".join(f"('{c}', {a}::double, {o}::double)" for c, a, o in CITY_COORDS)


@check("j01_city_lookup", with_sql(f"""
select reading_id, g.city, coalesce(d.lat, 6.14::double) as lat, coalesce(d.lon, 1.21::double) as lon
from (select reading_id, case when reading_id % 8 = 0 then 'Kara' when reading_id % 8 = 1 then 'Lome' else city end as city from grid_readings) g
left join (values {_CITY_VALUES}) d(city, lat, lon) on g.city = d.city"""))
def _(spark, sf):
    df = readings(spark, sf).select("reading_id", F.when(F.col("reading_id") % 8 == 0, "Kara").when(F.col("reading_id") % 8 == 1, "Lome").otherwise(F.col("city")).alias("city"))
    return with_coordinates(df, city_dimension(spark))


@check("j01_region_lookup", with_sql("""
select reading_id, region, 6.14::double as lat, 1.21::double as lon from grid_readings"""))
def _(spark, sf):
    return with_coordinates(readings(spark, sf).select("reading_id", "region"), region_dimension(spark), "region")


_MOVED = {"AFRICA": "Maritime", "AMERICA": "Kara", "ASIA": "Savanes", "EUROPE": "Centrale"}


@check("j01_region_points", with_sql("""
select reading_id, case region when 'AFRICA' then 'Maritime' when 'AMERICA' then 'Kara' when 'ASIA' then 'Savanes' when 'EUROPE' then 'Centrale' else region end as region,
  case region when 'AFRICA' then 6.3 when 'AMERICA' then 9.55 when 'ASIA' then 10.5 when 'EUROPE' then 8.65 else 6.14 end::double as lat,
  case region when 'AFRICA' then 1.3 when 'AMERICA' then 1.19 when 'ASIA' then 0.3 when 'EUROPE' then 1.15 else 1.21 end::double as lon
from grid_readings"""))
def _(spark, sf):
    """Four regions bear names of the dimension, the fifth takes the default point."""
    moved = readings(spark, sf).select("reading_id", "region").replace(_MOVED, subset=["region"])
    return with_coordinates(moved, region_dimension(spark), "region")


@check("j03_row_against_total", with_sql(f"""
select reading_id, {even('(total_load_mw - lo)/(hi - lo)')} as scaled from grid_readings, (select min(total_load_mw) as lo, max(total_load_mw) as hi from grid_readings)"""))
def _(spark, sf):
    from gridloom.operators.encode import min_max

    return min_max(readings(spark, sf), "total_load_mw", "scaled").select("reading_id", half_even(F.col("scaled"), 6).alias("scaled"))


# ------------------------------------------------------------------ windows

@check("w01_row_number", with_sql("""
select region, reading_id, row_number() over (partition by region order by total_load_mw desc, reading_id) as rn
from grid_readings qualify rn <= 20"""))
def _(spark, sf):
    w = Window.partitionBy("region").orderBy(F.desc("total_load_mw"), "reading_id")
    return readings(spark, sf).select("region", "reading_id", F.row_number().over(w).cast("long").alias("rn")).filter("rn <= 20")


def _over(frame: str = "", by: str = "") -> str:
    return f"over ({f'partition by {by} ' if by else ''}order by datetime, reading_id {frame})"


@check("w02_centred_mean", with_sql(f"""
select reading_id, {even('avg(total_load_mw) ' + _over('rows between 2 preceding and 2 following'))} as smoothed from grid_readings"""))
def _(spark, sf):
    df = readings(spark, sf).select("reading_id", "datetime", "total_load_mw")
    out = ordered.bounded_windows(df, ORDER, lambda w: {"smoothed": F.avg("total_load_mw").over(w.rowsBetween(-2, 2))}, before=2, after=2)
    return out.select("reading_id", half_even(F.col("smoothed"), 6).alias("smoothed"))


def _lag_sql(by: str = "") -> str:
    cols = []
    for n in (1, 3, 6, 12, 24):
        cols += [f"lag(total_load_mw, {n}) {_over(by=by)} as load_lag_{n}h", f"lag(outage_risk, {n}) {_over(by=by)} as outage_risk_lag_{n}h"]
    for n in (3, 6, 24):
        frame = _over(f"rows between {n - 1} preceding and current row", by)
        cols += [f"{even(f'avg(total_load_mw) {frame}')} as load_roll_mean_{n}h",
                 f"{even(f'coalesce(stddev_samp(total_load_mw) {frame}, 0.0::double)', 4)} as load_roll_std_{n}h",
                 f"max(outage_risk) {frame} as risk_roll_max_{n}h"]
    return "select reading_id, " + ", ".join(cols) + " from grid_readings"


def _lags(df, by):
    out = windows.with_lag_features(df.select("reading_id", "datetime", "city", "total_load_mw", "outage_risk"), ORDER, by, block_rows=1000)
    return out.withColumns(
        {f"load_roll_mean_{n}h": half_even(F.col(f"load_roll_mean_{n}h"), 6) for n in (3, 6, 24)}
        | {f"load_roll_std_{n}h": half_even(F.col(f"load_roll_std_{n}h"), 4) for n in (3, 6, 24)}
    ).drop("datetime", "city", "total_load_mw", "outage_risk")


@check("w03_w06_lag_features", with_sql(_lag_sql()))
def _(spark, sf):
    return _lags(readings(spark, sf), [])


@check("w03_w06_lag_features_by_city", with_sql(_lag_sql("city")))
def _(spark, sf):
    return _lags(readings(spark, sf), ["city"])


@check("w07_full_rolling_mean", with_sql(f"""
select reading_id, case when count(total_load_mw) {_over('rows between 6 preceding and current row')} = 7
  then {even('avg(total_load_mw) ' + _over('rows between 6 preceding and current row'))} end as rolled from grid_readings"""))
def _(spark, sf):
    df = readings(spark, sf).select("reading_id", "datetime", "total_load_mw")
    out = ordered.bounded_windows(df, ORDER, lambda w: {"rolled": windows.full_rolling_mean("total_load_mw", 7, w)}, before=6)
    return out.select("reading_id", half_even(F.col("rolled"), 6).alias("rolled"))


_W10_LAGS = ", ".join(f"lag(total_load_mw, {24 - i}) over (order by datetime, reading_id) as step_{i + 1}" for i in range(24))


@check("w10_lag_matrix", with_sql(f"""
select reading_id, target, {', '.join(f'step_{i + 1}' for i in range(24))} from (
  select reading_id, total_load_mw as target, {_W10_LAGS},
    row_number() over (order by datetime, reading_id) as i, count(*) over () as n from grid_readings)
where i > 24 and i <= n - 5"""))
def _(spark, sf):
    out = windows.lag_matrix(readings(spark, sf), "total_load_mw", ORDER, block_rows=2000)
    return out.select("reading_id", "target", *[F.col("lags")[i].alias(f"step_{i + 1}") for i in range(24)])


@check("w11_centred_two_by_period", with_sql(f"""
select reading_id, case when count(*) {_over('rows between 12 preceding and 12 following')} = 25 then {even(
  '(sum(total_load_mw) ' + _over('rows between 12 preceding and 11 following') + ' + sum(total_load_mw) ' + _over('rows between 11 preceding and 12 following') + ')/48')} end as trend
from grid_readings"""))
def _(spark, sf):
    df = readings(spark, sf).select("reading_id", "datetime", "total_load_mw")
    out = ordered.bounded_windows(df, ORDER, lambda w: {"trend": windows.centred_mean("total_load_mw", 24, w)}, before=12, after=12)
    return out.select("reading_id", half_even(F.col("trend"), 6).alias("trend"))


# --------------------------------------------------- sorts, samples, splits

@check("o02_critical_table", with_sql("""
select cast(datetime as varchar) as datetime_text, region, city, outage_risk, total_load_mw from grid_readings where outage_risk > 90
order by outage_risk desc, datetime, reading_id limit 20"""))
def _(spark, sf):
    top = readings(spark, sf).filter("outage_risk > 90").orderBy(F.desc("outage_risk"), "datetime", "reading_id").limit(20)
    return top.select(F.col("datetime").cast("string").alias("datetime_text"), "region", "city", "outage_risk", "total_load_mw")


@check("o04_bounded_sample", with_sql(f"select reading_id from grid_readings order by {_hash('reading_id')}, reading_id limit 3000"))
def _(spark, sf):
    return sampling.bounded_sample(readings(spark, sf), "reading_id").select("reading_id")


@check("o05_stratified_split", with_sql(f"""
select reading_id, blackout, case when rn <= case when blackout = 1 then t1 else ceil(round(0.2*(n0+n1), 9)) - t1 end then 'test' else 'train' end as part
from (select reading_id, blackout, row_number() over (partition by blackout order by {_hash('reading_id')}) as rn from grid_readings),
  (select n0, n1, case when ceil(round(0.2*(n0+n1),9)) - floor(0.2*n0) - floor(0.2*n1) >= 2 or
     (ceil(round(0.2*(n0+n1),9)) - floor(0.2*n0) - floor(0.2*n1) = 1 and 0.2*n1 - floor(0.2*n1) > 0.2*n0 - floor(0.2*n0))
     then floor(0.2*n1) + 1 else floor(0.2*n1) end as t1
   from (select count(*) filter (blackout = 0) as n0, count(*) filter (blackout = 1) as n1 from grid_readings))"""))
def _(spark, sf):
    train, test = sampling.stratified_split(readings(spark, sf), "reading_id", "blackout", in_memory_rows=2000)
    pick = lambda d, p: d.select("reading_id", "blackout", F.lit(p).alias("part"))
    return pick(train, "train").unionByName(pick(test, "test"))


@check("o06_chronological_split", """
select o_orderkey, case when i <= floor(0.8*n) then 'train' else 'test' end as part from (
  select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as i, count(*) over () as n from orders)""")
def _(spark, sf):
    train, test = sampling.chronological_split(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", in_memory_rows=1000)
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(test.select("o_orderkey", F.lit("test").alias("part")))


@check("o08_fitting_sample", with_sql(f"select reading_id from grid_readings order by {_hash('reading_id', 7)}, reading_id limit 5000"))
def _(spark, sf):
    return sampling.bounded_sample(readings(spark, sf), "reading_id", 5000, seed=7).select("reading_id")


def _uniform(tag: str) -> str:
    return f"((('0x' || substr(md5(city || ':' || point || ':{tag}:42'), 1, 13))::bigint)::double + 0.5::double) / {float(1 << 52)!r}::double"


def _around(centre: float, turn: str) -> str:
    return even(f"{centre}::double + 0.15::double*sqrt(-2*ln({_uniform('r')}))*{turn}(2*pi()*{_uniform('a')})")


# No city of the fixture is in the list of places, so all take the default point.
@check("o09_jittered_points", with_sql(f"""
select city, point, {_around(DEFAULT_COORDS[0], 'cos')} as lat, {_around(DEFAULT_COORDS[1], 'sin')} as lon, {even('pct/100')} as weight
from (select city, unnest(range(1, greatest(1, floor(sum(blackout)/50))::bigint + 1)) as point,
  {even(even('avg(blackout)', 3) + '*100', 2)} as pct from grid_readings group by city)"""))
def _(spark, sf):
    from gridloom.operators.aggregates import city_statistics

    out = jittered_points(city_statistics(readings(spark, sf)))
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("lat", "lon", "weight")})


@check("o09_jittered_counts", with_sql("""
select city, greatest(1, floor(sum(blackout)/50))::bigint as n_points from grid_readings group by city"""))
def _(spark, sf):
    from gridloom.operators.aggregates import city_statistics

    return jittered_points(city_statistics(readings(spark, sf))).groupBy("city").agg(F.count("*").alias("n_points"))
