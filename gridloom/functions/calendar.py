"""Calendar columns derived from a timestamp and from the raw ``hour`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.schema import PEAK_HOURS, TIME_OF_DAY


def date_parts(ts: Column) -> dict[str, Column]:
    """Year to quarter; weekday counts from Monday = 0, weeks are ISO weeks."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "week": F.weekofyear(ts),
        "quarter": F.quarter(ts),
    }


def weekend_flag(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = 2 * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def time_of_day(hour: Column) -> Column:
    """Named part of the day; hours outside 0..23 become the text ``nan``."""
    bucket = F.when(hour <= -1, F.lit("nan"))
    for upper, label in TIME_OF_DAY:
        bucket = bucket.when(hour <= upper, F.lit(label))
    return bucket.otherwise(F.lit("nan"))


def peak_hour_flag(hour: Column) -> Column:
    return F.coalesce(hour.isin(*PEAK_HOURS), F.lit(False)).cast("int")


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def with_calendar(df: DataFrame, ts: str = "datetime", hour: str = "hour") -> DataFrame:
    """Add the sixteen calendar columns in one projection."""
    t, h = F.col(ts), F.col(hour)
    parts = date_parts(t)
    hour_sin, hour_cos = cyclic(h, 24)
    month_sin, month_cos = cyclic(parts["month"], 12)
    dow_sin, dow_cos = cyclic(parts["day_of_week"], 7)
    return df.withColumns(
        parts
        | {
            "is_weekend": weekend_flag(t),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "time_of_day": time_of_day(h),
            "is_peak_hour": peak_hour_flag(h),
        }
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    minutes = (
        F.extract(F.lit("DAY"), since).cast("long") * 1440
        + F.extract(F.lit("HOUR"), since) * 60
        + F.extract(F.lit("MINUTE"), since)
    )
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
