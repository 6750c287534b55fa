"""One stored cube behind the dashboard: sums and counts by day, hour, place, season and event.

The readings are read once, by an aggregation that tasks start before the
shuffle. The cube grows with days x hours x cities x events, not with the
readings; every table of a refresh is derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rounding import half_even
from gridloom.operators import series
from gridloom.operators.filters import select_readings
from gridloom.session import materialize

DIMENSIONS = ("hour", "region", "city", "season", "event")
MEASURES = ("total_load_mw", "outage_risk", "blackout", "overload", "load_shedding_mw", "energy_price")
_WEEKDAYS = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]  # fixed values


def build(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """The cube, written once; ``datetime`` is the start of the day.

    Dimensions may be null. A measure that the table lacks is left out, and so
    are the tables that need it.
    """
    cells = [F.count("*").alias("rows")]
    for m in (m for m in MEASURES if m in df.columns):
        cells += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}")]
    if "total_load_mw" in df.columns:
        cells += [F.min("total_load_mw").alias("min_load"), F.max("total_load_mw").alias("max_load")]
    cube = df.groupBy(series.period_start(F.col(ts), "day").alias("datetime"), *[d for d in DIMENSIONS if d in df.columns]).agg(*cells)
    return materialize(cube, "cube")


def _total(measure: str) -> Column:
    return F.sum(f"sum_{measure}")


def _mean(measure: str) -> Column:
    return F.try_divide(F.sum(f"sum_{measure}").cast("double"), F.sum(f"n_{measure}"))


def kpis(cube: DataFrame, digits: int = 6) -> DataFrame:
    """One row of headline figures; an empty cube gives nulls and no rows counted."""
    return cube.agg(
        half_even(_mean("blackout") * 100, digits).alias("blackout_rate_pct"),
        half_even(_mean("outage_risk"), digits).alias("avg_risk"),
        half_even(_total("load_shedding_mw"), digits).alias("total_shedding"),
        half_even(_mean("overload") * 100, digits).alias("overload_rate_pct"),
        half_even(_mean("total_load_mw"), digits).alias("avg_load"),
        _total("blackout").alias("blackouts"),
        _total("overload").alias("overloads"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
    )


def rate_by(cube: DataFrame, key: str, flag: str, digits: int = 2) -> DataFrame:
    rates = cube.groupBy(key).agg(_total(flag).alias("flagged"), F.sum(f"n_{flag}").alias("total"))
    share = half_even(F.try_divide(F.col("flagged").cast("double"), F.col("total")) * 100, digits)
    return rates.withColumn("rate_pct", share).orderBy("rate_pct", key)


def mean_by(cube: DataFrame, key: str, measure: str, digits: int = 6) -> DataFrame:
    return cube.groupBy(key).agg(half_even(_mean(measure), digits).alias(f"mean_{measure}")).orderBy(key)


def total_by(cube: DataFrame, key: str, measure: str, digits: int = 6) -> DataFrame:
    name = f"total_{measure}"
    return cube.groupBy(key).agg(half_even(_total(measure), digits).alias(name)).orderBy(name, key)


def risk_by_hour(cube: DataFrame, digits: int = 6) -> DataFrame:
    return cube.groupBy("hour").agg(
        half_even(_mean("outage_risk"), digits).alias("risk"), _total("blackout").alias("blackouts")
    ).orderBy("hour")


def load_by_month(cube: DataFrame, digits: int = 6) -> DataFrame:
    return cube.groupBy(F.month("datetime").alias("month")).agg(
        half_even(_mean("total_load_mw"), digits).alias("mean"), F.max("max_load").alias("max"), F.min("min_load").alias("min")
    ).orderBy("month")


def load_heatmap(cube: DataFrame, digits: int = 6) -> DataFrame:
    """Mean load per hour and weekday; always seven weekday columns."""
    wide = cube.withColumn("_dow", F.weekday("datetime")).groupBy("hour").pivot("_dow", list(range(7))).agg(_mean("total_load_mw"))
    return wide.select("hour", *[half_even(F.col(str(i)), digits).alias(n) for i, n in enumerate(_WEEKDAYS)]).orderBy("hour")


def event_statistics(cube: DataFrame, digits: int = 2) -> DataFrame:
    means = {"avg_load": "total_load_mw", "avg_risk": "outage_risk", "blackout_rate": "blackout", "avg_shedding": "load_shedding_mw"}
    n = F.coalesce(F.sum(F.when(F.col("event").isNotNull(), F.col("rows"))), F.lit(0)).alias("n")
    return cube.groupBy("event").agg(n, *[half_even(_mean(m), digits).alias(name) for name, m in means.items()]).orderBy(
        F.desc("avg_risk"), "event")


def resample(cube: DataFrame, measure: str, freq: str = "day") -> DataFrame:
    """Mean per day or week; empty periods appear with a null."""
    period = series.period_start(F.col("datetime"), freq).alias(series.TS)
    return series.on_spine(cube.groupBy(F.lit("All").alias(series.KEY), period).agg(_mean(measure).alias(series.VALUE)), freq)


def refresh(cube: DataFrame, **choices) -> dict[str, DataFrame]:
    """The grouped tables for one choice of filters (whole days), lazily; those whose measures are missing are left out."""
    if choices.get("literal_end"):
        raise ValueError("the cube holds whole days")
    part = select_readings(cube, **choices)
    views = {
        "kpis": (lambda: kpis(part), MEASURES[:5]),
        "daily_load": (lambda: resample(part, "total_load_mw"), ["total_load_mw"]),
        "weekly_price": (lambda: resample(part, "energy_price", "week"), ["energy_price"]),
        "blackout_rate": (lambda: rate_by(part, "region", "blackout"), ["blackout"]),
        "load_heatmap": (lambda: load_heatmap(part), ["total_load_mw"]),
        "load_by_hour": (lambda: mean_by(part, "hour", "total_load_mw"), ["total_load_mw"]),
        "load_by_month": (lambda: load_by_month(part), ["total_load_mw"]),
        "risk_by_hour": (lambda: risk_by_hour(part), ["outage_risk", "blackout"]),
        "risk_by_season": (lambda: mean_by(part, "season", "outage_risk"), ["outage_risk"]),
        "risk_by_event": (lambda: mean_by(part, "event", "outage_risk"), ["outage_risk"]),
        "shedding_by_region": (lambda: total_by(part, "region", "load_shedding_mw"), ["load_shedding_mw"]),
        "events": (lambda: event_statistics(part), ["total_load_mw", "outage_risk", "blackout", "load_shedding_mw"]),
    }
    return {name: view() for name, (view, needs) in views.items() if all(f"sum_{m}" in cube.columns for m in needs)}
