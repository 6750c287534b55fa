"""Tables of one dashboard refresh and of the exploration views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import with_calendar
from gridloom.functions.energy import with_energy
from gridloom.operators import aggregates as A
from gridloom.operators import series
from gridloom.operators.filters import select_readings
from gridloom.operators.sampling import bounded_sample
from gridloom.schema import CORRELATION_COLUMNS


def critical_table(df: DataFrame, tie: str, threshold: float = 90, rows: int = 20) -> DataFrame:
    """Riskiest readings with the time as text."""
    top = df.filter(F.col("outage_risk") > threshold).orderBy(F.desc("outage_risk"), "datetime", tie).limit(rows)
    return top.select(
        F.col("datetime").cast("string").alias("datetime"), "region", "city", "outage_risk", "total_load_mw",
        "available_power_mw", "load_shedding_mw", "event",
    )


def refresh(df: DataFrame, key: str = "reading_id", **choices) -> dict[str, DataFrame]:
    """All tables for one choice of filters, lazily, over one filtered input."""
    part = select_readings(df, **choices)
    return {
        "kpis": A.kpi_row(part),
        "daily_load": series.resample(part, "total_load_mw", freq="day"),
        "blackout_rate": A.rate_by(part, "region", "blackout"),
        "load_heatmap": A.hour_weekday_load(part),
        "risk_by_hour": A.risk_by_hour(part),
        "risk_by_event": A.mean_by(part, "event", "outage_risk"),
        "scatter": A.scatter(bounded_sample(part, key), "available_power_mw", "total_load_mw", size="outage_risk"),
        "critical": critical_table(part, key),
    }


def exploration(df: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the exploration views; a view whose columns are missing is left out."""
    full = with_energy(with_calendar(df))
    views = {
        "load_histogram": lambda: A.histogram(full, "total_load_mw", 50),
        "blackout_rate": lambda: A.rate_by(full, "region", "blackout"),
        "load_by_hour": lambda: A.mean_by(full, "hour", "total_load_mw"),
        "temperature_load": lambda: A.scatter(full, "temperature", "total_load_mw"),
        "risk_by_season": lambda: A.mean_by(full, "season", "outage_risk"),
        "daily_load": lambda: series.resample(full, "total_load_mw", freq="day"),
        "correlations": lambda: A.correlations(full, list(CORRELATION_COLUMNS["energy"])),
        "load_heatmap": lambda: A.hour_weekday_load(full),
        "risk_by_hour": lambda: A.risk_by_hour(full),
        "load_by_month": lambda: A.load_by_month(full),
        "load_by_peak": lambda: A.box_summary(full, ["total_load_mw"], ("is_peak_hour",)),
        "shedding_by_region": lambda: A.total_by(full, "region", "load_shedding_mw"),
        "weekly_price": lambda: series.resample(full, "energy_price", freq="week"),
        "events": lambda: A.event_statistics(full),
        "regions": lambda: A.region_statistics(full),
    }
    return {name: view() for name, view in views.items()}
