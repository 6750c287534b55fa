"""Row filters. All of them are plain predicates, so scans can apply them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import small

ALL = "Toutes"  # fixed value: the "no restriction" choice


def select_readings(
    df: DataFrame,
    region: str = ALL,
    city: str = ALL,
    season: str = ALL,
    start: dt.date | None = None,
    end: dt.date | None = None,
    literal_end: bool = False,
    ts: str = "datetime",
) -> DataFrame:
    """Restrict by region, city, season and an inclusive date range.

    ``literal_end=True`` compares with midnight of the end date, which keeps
    only the first instant of that day.
    """
    for column, choice in (("region", region), ("city", city), ("season", season)):
        if choice not in (ALL, None):
            df = df.filter(F.col(column) == choice)
    if start is not None:
        df = df.filter(F.col(ts) >= _midnight(start))
    if end is not None and literal_end:
        df = df.filter(F.col(ts) <= _midnight(end))
    elif end is not None:
        df = df.filter(F.col(ts) < _midnight(end + dt.timedelta(days=1)))
    return df


def _midnight(day: dt.date):
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.filter(F.col(column) > threshold)


def exceeds(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.filter(F.col(left) > F.col(right))


def flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 1)


def groups_larger_than(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("observations")).filter(F.col("observations") > rows)


def long_enough(series: DataFrame, key: str, points: int = 100) -> DataFrame:
    """Drop the series that have fewer than ``points`` points."""
    kept = series.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= points)
    return series.join(small(kept.select(key)), key, "left_semi")
