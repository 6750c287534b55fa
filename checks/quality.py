"""Profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import GAPPY_SQL, check, even, gappy, readings, with_sql
from gridloom.operators import clean as C
from gridloom.operators import profile as Q
from gridloom.operators.ordered import fill_next

ORDER = ["datetime", "reading_id"]
NUMBERS = [
    "total_load_mw", "available_power_mw", "voltage", "frequency", "temperature", "humidity",
    "transformer_temp", "outage_risk", "energy_price",
]
COLUMNS = ["reading_id", "region", "city", "season", "event", "temperature", "voltage", "total_load_mw", "outage_risk"]
TYPES = {"reading_id": "bigint", "region": "string", "city": "string", "season": "string", "event": "string",
         "temperature": "double", "voltage": "double", "total_load_mw": "double", "outage_risk": "double"}


def _doubled(spark, sf):
    """Every third reading twice."""
    df = gappy(spark, sf).select(*COLUMNS)
    return df.unionAll(df.filter(F.col("reading_id") % 3 == 0))


_DOUBLED = "select {0} from gappy union all select {0} from gappy where reading_id % 3 = 0".format(", ".join(COLUMNS))


def _with_gaps(body: str, **more: str) -> str:
    return with_sql(body, gappy=GAPPY_SQL, **more)


def _per_column(template: str, columns, source: str) -> str:
    return " union all ".join(f"select {template.format(c=c, t=TYPES.get(c))} from {source}" for c in columns)


_MISSING = f"""'{{c}}' as "column", cast(count(*) - count({{c}}) as bigint) as missing,
  {even('100.0::double*(count(*) - count({c}))/count(*)', 2)} as missing_pct"""


@check("q01_summary", _with_gaps(
    "select (select count(*) from doubled) as n_rows, cast(9 as bigint) as n_columns, "
    "(select count(*) from doubled) - (select count(*) from (select distinct * from doubled)) as duplicates, x.* from ("
    + _per_column(_MISSING + ", '{t}' as dtype", COLUMNS, "doubled") + ") x", doubled=_DOUBLED))
def _(spark, sf):
    return Q.summary(_doubled(spark, sf))


def _describe_sql(source: str, columns, digits: int) -> str:
    parts = []
    for c in columns:
        shown = {
            "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "p25": f"quantile_cont({c}, 0.25)",
            "p50": f"quantile_cont({c}, 0.5)", "p75": f"quantile_cont({c}, 0.75)", "max": f"max({c})",
        }
        parts.append(f"""select '{c}' as "column", count({c}) as count, """
                     + ", ".join(f'{even(e, digits)} as "{n}"' for n, e in shown.items()) + f" from {source}")
    return " union all ".join(parts)


@check("q02_describe", _with_gaps(_describe_sql("gappy", NUMBERS, 2)))
def _(spark, sf):
    return Q.describe(gappy(spark, sf), NUMBERS, 2)


@check("q02_describe_narrowing", _with_gaps(_describe_sql("gappy", NUMBERS[:3], 4)))
def _(spark, sf):
    """The same figures with the many-row quantile path forced."""
    from gridloom.functions.rounding import half_even
    from gridloom.operators.quantiles import quantiles

    df = gappy(spark, sf)
    exact = quantiles(df, NUMBERS[:3], [0.25, 0.5, 0.75], in_memory_rows=500)
    base = Q.describe(df, NUMBERS[:3], 4).drop("p25", "p50", "p75")
    q = F.col("quantiles")
    return base.join(
        exact.select("column", *[half_even(q[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]), "column")


@check("q03_missing_report", _with_gaps(
    "select * from (" + _per_column(_MISSING, COLUMNS, "gappy") + ") where missing > 0"))
def _(spark, sf):
    return Q.missing_report(gappy(spark, sf).select(*COLUMNS))


@check("q04_duplicate_rows", _with_gaps(
    "select (select count(*) from doubled) - (select count(*) from (select distinct * from doubled)) as duplicates",
    doubled=_DOUBLED))
def _(spark, sf):
    return Q.duplicate_rows(_doubled(spark, sf))


for _target in ("blackout", "overload"):
    @check(f"q05_value_shares_{_target}", with_sql(
        f"select {_target}, count(*) as n, {even('count(*)::double/(select count(*) from grid_readings)', 3)} as share "
        f"from grid_readings group by 1"))
    def _(spark, sf, target=_target):
        return Q.value_shares(readings(spark, sf), target)


@check("q06_cardinality", _with_gaps(" union all ".join(
    f"""select '{c}' as "column", count(distinct {c}) as n_unique from gappy""" for c in ("region", "city", "season", "event"))))
def _(spark, sf):
    return Q.cardinalities(gappy(spark, sf), ["region", "city", "season", "event"])


@check("q06_top_values", _with_gaps("""
select 'city' as "column", city as value, count(*) as n from gappy where city is not null
group by city order by n desc, city limit 8"""))
def _(spark, sf):
    return Q.top_values(gappy(spark, sf), "city", 8)


@check("q07_coverage", with_sql("""
select min(datetime) as first_ts, max(datetime) as last_ts,
  cast(floor(epoch_us(max(datetime)) / 86400e6 - epoch_us(min(datetime)) / 86400e6) as bigint) as days from grid_readings"""))
def _(spark, sf):
    return Q.coverage(readings(spark, sf))


@check("q08_filter_domains", with_sql(" union all ".join(
    f"select distinct '{c}' as filter, {c} as value from grid_readings where {c} is not null" for c in ("region", "city", "season"))))
def _(spark, sf):
    return Q.filter_domains(readings(spark, sf))


@check("q08_date_range", with_sql(
    "select cast(min(datetime) as date) as date_min, cast(max(datetime) as date) as date_max from grid_readings"))
def _(spark, sf):
    return Q.date_range(readings(spark, sf))


@check("c01_drop_duplicates", _with_gaps("select distinct * from doubled", doubled=_DOUBLED))
def _(spark, sf):
    return C.drop_duplicate_rows(_doubled(spark, sf))


@check("c02_normalize_names", "select n_nationkey, n_name as nation_name, n_regionkey as region_key from nation")
def _(spark, sf):
    from checks.base import table

    n = table(spark, sf, "nation")
    return C.normalize_names(n.toDF(" N_NationKey", "Nation Name ", "Region Key"))


@check("c03_sorted_index", with_sql(
    "select reading_id, datetime, row_number() over (order by datetime, reading_id) - 1 as row_index from grid_readings"))
def _(spark, sf):
    from gridloom.operators.ordered import number_rows

    return number_rows(readings(spark, sf).select("reading_id", "datetime"), ORDER)


@check("c04_trim", with_sql("select reading_id, region, city, season, event from grid_readings"))
def _(spark, sf):
    padded = readings(spark, sf).select(
        "reading_id", *[F.concat(F.lit(" "), F.col(c), F.lit("  ")).alias(c) for c in ("region", "city", "season", "event")])
    return C.trim_categories(padded)


@check("c05_fill_event", _with_gaps("select reading_id, coalesce(event, 'No Event') as event from gappy"))
def _(spark, sf):
    return C.fill_event(gappy(spark, sf)).select("reading_id", "event")


def _interpolated(c: str) -> str:
    prev = "last_value({} ignore nulls) over (order by datetime, reading_id rows between unbounded preceding and current row)"
    nxt = "first_value({} ignore nulls) over (order by datetime, reading_id rows between current row and unbounded following)"
    t = f"case when {c} is not null then epoch_us(datetime) end"
    return f"{prev.format(c)} as v0_{c}, {nxt.format(c)} as v1_{c}, {prev.format(t)} as t0_{c}, {nxt.format(t)} as t1_{c}"


_GAPS = ("temperature", "voltage", "total_load_mw", "outage_risk")


@check("c06_interpolate_time", _with_gaps(
    "select reading_id, " + ", ".join(
        even(f"coalesce({c}, case when t1_{c} = t0_{c} then v0_{c} else v0_{c} + (v1_{c}-v0_{c})*(epoch_us(datetime)-t0_{c})::double/(t1_{c}-t0_{c}) end, v0_{c}, v1_{c})", 6)
        + f" as {c}" for c in _GAPS) + " from near",
    near="select *, " + ", ".join(_interpolated(c) for c in _GAPS) + " from gappy"))
def _(spark, sf):
    from gridloom.functions.rounding import half_even
    from gridloom.operators.ordered import interpolate_time

    out = interpolate_time(gappy(spark, sf).select("reading_id", "datetime", *_GAPS), list(_GAPS), "datetime", ORDER)
    return out.select("reading_id", *[half_even(F.col(c), 6).alias(c) for c in _GAPS])


@check("c07_fill_mode", _with_gaps("""
select reading_id, coalesce(season, (select season from gappy where season is not null group by season order by count(*) desc, season limit 1)) as season
from gappy"""))
def _(spark, sf):
    return C.fill_mode(gappy(spark, sf).select("reading_id", "season"), ["season"])


_LIMITS = "select " + ", ".join(f"quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.75) as b_{c}" for c in NUMBERS) + " from {}"


def _out(c: str, factor: str = "1.5") -> str:
    return f"coalesce({c} < a_{c} - {factor}*(b_{c}-a_{c}) or {c} > b_{c} + {factor}*(b_{c}-a_{c}), false)"


@check("c08_iqr_mask", _with_gaps(
    "select reading_id, " + ", ".join(f"{_out(c)} as {c}_outlier" for c in ("total_load_mw", "voltage")) + " from gappy, limits",
    limits=_LIMITS.format("gappy")))
def _(spark, sf):
    cols = ["total_load_mw", "voltage"]
    return C.iqr_mask(gappy(spark, sf), cols).select("reading_id", *[f"{c}_outlier" for c in cols])


@check("c09_zscore_mask", _with_gaps("""
select reading_id, coalesce(abs((total_load_mw - m)/s) > 3, false) as total_load_mw_outlier
from gappy, (select avg(total_load_mw) as m, stddev_samp(total_load_mw) as s from gappy)"""))
def _(spark, sf):
    return C.zscore_mask(gappy(spark, sf), ["total_load_mw"]).select("reading_id", "total_load_mw_outlier")


# Loads reach beyond the bounds and have quartile outliers; temperatures reach beyond them without any.
def _wild(spark, sf):
    return readings(spark, sf).select(
        "reading_id", (F.col("total_load_mw") * 4 - 50).alias("total_load_mw"),
        (F.col("temperature") + 10).alias("temperature"), "voltage", "outage_risk", "humidity",
        "available_power_mw", "frequency", "transformer_temp")


_WILD = """select reading_id, total_load_mw*4-50 as total_load_mw, temperature+10 as temperature, voltage, outage_risk, humidity,
  available_power_mw, frequency, transformer_temp, energy_price from grid_readings"""


@check("c10_clip_outliers", with_sql(
    "select reading_id, case when (select bool_or(" + _out("total_load_mw") + ") from wild, limits) "
    "then greatest(least(total_load_mw, 1000.0::double), 0.0::double) else total_load_mw end as total_load_mw, temperature, voltage from wild",
    wild=_WILD, limits=_LIMITS.format("wild")))
def _(spark, sf):
    return C.handle_outliers(_wild(spark, sf), "clip").select("reading_id", "total_load_mw", "temperature", "voltage")


@check("c11_remove_outliers", with_sql(
    "select reading_id, total_load_mw, voltage from wild2", wild=_WILD,
    lim1="select quantile_cont(total_load_mw, 0.25) as a_total_load_mw, quantile_cont(total_load_mw, 0.75) as b_total_load_mw from wild",
    wild1=f"select wild.* from wild, lim1 where not {_out('total_load_mw')}",
    lim2="select quantile_cont(voltage, 0.25) as a_voltage, quantile_cont(voltage, 0.75) as b_voltage from wild1",
    wild2=f"select wild1.* from wild1, lim2 where not {_out('voltage')}"))
def _(spark, sf):
    return C.remove_outliers(_wild(spark, sf), ["total_load_mw", "voltage"]).select("reading_id", "total_load_mw", "voltage")


@check("c12_fill_next", _with_gaps("select reading_id, " + ", ".join(
    f"coalesce(first_value({c} ignore nulls) over (order by datetime, reading_id rows between current row and unbounded following), 0.0::double) as {c}"
    for c in _GAPS) + " from gappy"))
def _(spark, sf):
    return fill_next(gappy(spark, sf).select("reading_id", "datetime", *_GAPS), list(_GAPS), ORDER, block_rows=700).drop("datetime")


@check("c13_zero_fill", _with_gaps("select reading_id, " + ", ".join(f"coalesce({c}, 0.0::double) as {c}" for c in _GAPS) + " from gappy"))
def _(spark, sf):
    return C.zero_fill(gappy(spark, sf).select("reading_id", *_GAPS), _GAPS)
