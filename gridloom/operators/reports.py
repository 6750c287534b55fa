"""The named reports over the readings table.

Each report is a function of the readings; ``REPORTS`` is the registry that
``sources.tables`` exposes by name. Every ordering ends in a unique key, so
limits and ranks are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import year_month
from gridloom.functions.energy import deficit
from gridloom.functions.rounding import half_up, ratio


def _mean(column: str, name: str, digits: int = 2) -> Column:
    return half_up(F.avg(column), digits).alias(name)


def _total(column: str, name: str) -> Column:
    return F.sum(column).alias(name)


def _share_pct(flag: str, name: str) -> Column:
    return half_up(F.lit(100.0) * F.sum(flag) / F.count("*"), 2).alias(name)


def _rows(name: str) -> Column:
    return F.count("*").alias(name)


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        _rows("total_readings"),
        _total("blackout", "total_blackouts"),
        _total("overload", "total_overloads"),
        _mean("total_load_mw", "avg_load_mw"),
        _mean("outage_risk", "avg_outage_risk"),
        _mean("load_shedding_mw", "avg_shedding_mw"),
        F.min("datetime").alias("period_start"),
        F.max("datetime").alias("period_end"),
    )


def blackout_by_region(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("region")
        .agg(
            _rows("total"),
            _total("blackout", "blackouts"),
            _share_pct("blackout", "blackout_rate_pct"),
            _mean("outage_risk", "avg_risk"),
            _mean("load_shedding_mw", "avg_shedding"),
        )
        .orderBy(F.desc("blackout_rate_pct"), "region")
    )


def blackout_by_hour(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("hour")
        .agg(
            _rows("total"),
            _total("blackout", "blackouts"),
            _share_pct("blackout", "blackout_rate_pct"),
            _mean("total_load_mw", "avg_load"),
            _mean("outage_risk", "avg_risk"),
        )
        .orderBy("hour")
    )


def monthly_summary(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(year_month(F.col("datetime")).alias("month"))
        .agg(
            _rows("readings"),
            _total("blackout", "blackouts"),
            _total("overload", "overloads"),
            _mean("total_load_mw", "avg_load_mw"),
            _mean("available_power_mw", "avg_available_mw"),
            _mean("outage_risk", "avg_risk"),
            half_up(F.sum("load_shedding_mw"), 2).alias("total_shedding_mw"),
            _mean("temperature", "avg_temp"),
            _mean("energy_price", "avg_price"),
        )
        .orderBy("month")
    )


def top_risk_periods(df: DataFrame, threshold: float = 90, rows: int = 50) -> DataFrame:
    columns = [
        "datetime", "region", "city", "outage_risk", "total_load_mw",
        "available_power_mw", "load_shedding_mw", "event", "temperature", "voltage",
    ]
    return (
        df.filter(F.col("outage_risk") > threshold)
        .select(*columns)
        .orderBy(F.desc("outage_risk"), "datetime", "region", "city", "total_load_mw")
        .limit(rows)
    )


def event_impact(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("event")
        .agg(
            _rows("occurrences"),
            _mean("total_load_mw", "avg_load_mw"),
            _mean("outage_risk", "avg_risk"),
            _total("blackout", "blackouts"),
            _share_pct("blackout", "blackout_rate_pct"),
            _mean("load_shedding_mw", "avg_shedding"),
        )
        .orderBy(F.desc("avg_risk"), "event")
    )


def peak_load_analysis(df: DataFrame, per_region: int = 5) -> DataFrame:
    """Largest loads of each region; Spark trims every partition before the shuffle."""
    loudest = Window.partitionBy("region").orderBy(F.desc("total_load_mw"), "datetime", "city")
    return (
        df.withColumn("_place", F.row_number().over(loudest))
        .filter(F.col("_place") <= per_region)
        .select(
            "region", "city", "datetime", "total_load_mw", "available_power_mw",
            "outage_risk", "event", "temperature",
        )
        .orderBy("region", F.desc("total_load_mw"), "datetime")
    )


def power_deficit_windows(df: DataFrame, rows: int = 100) -> DataFrame:
    return (
        df.filter(F.col("total_load_mw") > F.col("available_power_mw"))
        .select(
            "datetime", "region", "city", "total_load_mw", "available_power_mw",
            deficit().alias("deficit_mw"), "outage_risk", "blackout", "load_shedding_mw",
        )
        .orderBy(F.desc("deficit_mw"), "datetime", "region", "city")
        .limit(rows)
    )


def transformer_stress(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("region", "city")
        .agg(
            _mean("transformer_temp", "avg_temp"),
            F.max("transformer_temp").alias("max_temp"),
            _mean("voltage", "avg_voltage"),
            _mean("frequency", "avg_frequency"),
            _total("overload", "overloads"),
            _total("blackout", "blackouts"),
        )
        .orderBy(F.desc("avg_temp"), "region", "city")
    )


def season_analysis(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("season")
        .agg(
            _rows("readings"),
            _mean("total_load_mw", "avg_load"),
            _mean("temperature", "avg_temp"),
            _mean("humidity", "avg_humidity"),
            _total("blackout", "blackouts"),
            _total("overload", "overloads"),
            _mean("renewable_power_mw", "avg_renewable_mw"),
            _mean("energy_price", "avg_price"),
        )
        .orderBy(F.desc("avg_load"), "season")
    )


def city_risk_ranking(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("city", "region")
        .agg(
            _rows("total"),
            _total("blackout", "blackouts"),
            _total("overload", "overloads"),
            _mean("outage_risk", "avg_risk"),
            half_up(F.max("outage_risk"), 2).alias("max_risk"),
            _mean("load_shedding_mw", "avg_shedding"),
            _mean("population_density", "avg_pop_density", 0),
        )
        .orderBy(F.desc("avg_risk"), "city", "region")
    )


def hourly_load_window(df: DataFrame) -> DataFrame:
    """Hourly means and their five-hour centred mean, over at most 24 grouped rows."""
    around = Window.orderBy("hour").rowsBetween(-2, 2)
    hourly = df.groupBy("hour").agg(
        F.avg("total_load_mw").alias("_mean"),
        half_up(F.max("total_load_mw"), 2).alias("max_load"),
        half_up(F.min("total_load_mw"), 2).alias("min_load"),
        _total("blackout", "blackouts"),
    )
    return hourly.select(
        "hour",
        half_up(F.col("_mean"), 2).alias("avg_load"),
        half_up(F.avg("_mean").over(around), 2).alias("smoothed_load"),
        "max_load", "min_load", "blackouts",
    ).orderBy("hour")


def renewable_contribution(df: DataFrame) -> DataFrame:
    renewable, available = F.avg("renewable_power_mw"), F.avg("available_power_mw")
    return (
        df.groupBy(year_month(F.col("datetime")).alias("month"), "region")
        .agg(
            half_up(renewable, 2).alias("avg_renewable"),
            half_up(available, 2).alias("avg_available"),
            half_up(F.lit(100.0) * ratio(renewable, available), 2).alias("renewable_pct"),
        )
        .orderBy("month", F.desc("renewable_pct"), "region")
    )


def transformer_report(df: DataFrame, min_rows: int = 100, rows: int = 15) -> DataFrame:
    """Hottest transformer sites among those with enough measured rows."""
    return (
        df.filter(F.col("transformer_temp").isNotNull())
        .groupBy("region", "city")
        .agg(
            _mean("transformer_temp", "avg_temp"),
            F.max("transformer_temp").alias("max_temp"),
            _mean("voltage", "avg_voltage"),
            _total("blackout", "blackouts"),
            _total("overload", "overloads"),
            _rows("observations"),
            _share_pct("blackout", "blackout_rate_pct"),
        )
        .filter(F.col("observations") > min_rows)
        .orderBy(F.desc("avg_temp"), "region", "city")
        .limit(rows)
    )


REPORTS = {
    "overview": overview,
    "blackout_by_region": blackout_by_region,
    "blackout_by_hour": blackout_by_hour,
    "monthly_summary": monthly_summary,
    "top_risk_periods": top_risk_periods,
    "event_impact": event_impact,
    "peak_load_analysis": peak_load_analysis,
    "power_deficit_windows": power_deficit_windows,
    "transformer_stress": transformer_stress,
    "season_analysis": season_analysis,
    "city_risk_ranking": city_risk_ranking,
    "hourly_load_window": hourly_load_window,
    "renewable_contribution": renewable_contribution,
}
