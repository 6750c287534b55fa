"""Cleaning: names, duplicates, missing values, outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.ordered import fill_next, interpolate_time, number_rows
from gridloom.operators.profile import numeric_columns
from gridloom.operators.quantiles import quantiles
from gridloom.schema import CATEGORY_COLUMNS, NO_EVENT, PHYSICAL_BOUNDS


def drop_duplicate_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Distinct rows. With ``key``, rows that differ in nothing else are duplicates, and the smallest key stays."""
    if key is None or key not in df.columns:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != key]
    return df.groupBy(*[F.col(f"`{c}`") for c in others]).agg(F.min(key).alias(key)).select(*[F.col(f"`{c}`") for c in df.columns])


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def trim_categories(df: DataFrame, columns=CATEGORY_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in columns if c in df.columns})


def clean_basic(df: DataFrame, order: list[str] | None = None, index: str = "row_index", key: str | None = None) -> DataFrame:
    """Distinct rows, tidy names, trimmed categories; numbered in time order if asked. ``key`` doesn't tell rows apart."""
    out = trim_categories(normalize_names(drop_duplicate_rows(df, key)))
    return number_rows(out, order, index) if order else out


def fill_event(df: DataFrame, column: str = "event", value: str = NO_EVENT) -> DataFrame:
    return df.fillna({column: value}) if column in df.columns else df


def mode(df: DataFrame, column: str):
    """Most frequent value, the smallest of equally frequent ones; None if all are null."""
    top = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
        .first()
    )
    return top[0] if top else None


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    values = {c: mode(df, c) for c in columns}
    return df.fillna({c: v for c, v in values.items() if v is not None}) if values else df


def columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c]]


def handle_missing(
    df: DataFrame, ts: str = "datetime", order: list[str] | None = None, by: list[str] = (),
    block_rows: int | None = None, index: str | None = None,
) -> DataFrame:
    """Impute by kind: events by a constant, numbers in time, other text by the mode."""
    df = fill_event(df)
    order = order or [ts]
    gaps = columns_with_nulls(df, [c for c in numeric_columns(df) if c not in (*order, index)])
    if gaps:
        df = interpolate_time(df, gaps, ts, order, by, block_rows, index)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return fill_mode(df, columns_with_nulls(df, text))


def iqr_limits(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper limit per column, for columns that hold values."""
    out = {}
    for row in quantiles(df, columns, [0.25, 0.75]).collect():
        if row["quantiles"]:
            low, high = row["quantiles"]
            out[row["column"]] = (low - factor * (high - low), high + factor * (high - low))
    return out


def _outside(column: str, limits: tuple[float, float]) -> Column:
    value = F.col(column)
    return F.coalesce((value < limits[0]) | (value > limits[1]), F.lit(False))


def iqr_mask(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Add ``<column>_outlier`` flags from the quartile limits."""
    limits = iqr_limits(df, columns, factor)
    return df.withColumns({f"{c}_outlier": _outside(c, limits[c]) if c in limits else F.lit(False) for c in columns})


def zscore_mask(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Add ``<column>_outlier`` flags from mean and sample deviation."""
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).alias("s")
    ).scalar()
    flags = {}
    for c in columns:
        z = F.try_divide(F.col(c) - stats[c]["m"], stats[c]["s"])
        flags[f"{c}_outlier"] = F.coalesce(F.abs(z) > threshold, F.lit(False))
    return df.withColumns(flags)


def columns_with_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> list[str]:
    """Columns with a value outside their quartile limits.

    A sketch proposes two values around each quartile and counts prove them.
    Where all limits between them agree on the column's extremes, that decides;
    the other columns get exact quartiles.
    """
    if not columns:
        return []
    shares, value = [0.2, 0.3, 0.7, 0.8], {c: F.col(c).cast("double") for c in columns}
    about = df.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, shares, 100).alias("q")).alias(c)
        for c, v in value.items()]).first()
    sure = {c: False for c in columns if not about[c]["n"]}
    plain = [c for c in columns if about[c]["n"] and all(map(math.isfinite, (about[c]["low"], about[c]["high"], *about[c]["q"])))]
    edges = {c: [F.count_if(value[c] < q if i % 2 == 0 else value[c] <= q) for i, q in enumerate(about[c]["q"])] for c in plain}
    counts = df.agg(*[F.array(*e).alias(c) for c, e in edges.items()]).first() if plain else {}
    for c in plain:
        n, low, high, (a, b, d, e) = about[c]
        held = all(counts[c][i] <= math.floor(p * (n - 1)) and counts[c][i + 1] > math.ceil(p * (n - 1)) for i, p in ((0, 0.25), (2, 0.75)))
        slack = 1e-9 * (abs(a) + abs(b) + abs(d) + abs(e))
        lower = (1 + factor) * a - factor * e - slack, (1 + factor) * b - factor * d + slack
        upper = (1 + factor) * d - factor * b - slack, (1 + factor) * e - factor * a + slack
        if held and (low < lower[0] or high > upper[1]):
            sure[c] = True
        elif held and low >= lower[1] and high <= upper[0]:
            sure[c] = False
    limits = iqr_limits(df, [c for c in columns if c not in sure], factor) if len(sure) < len(columns) else {}
    found = df.agg(*[F.count_if(_outside(c, limits[c])).alias(c) for c in limits]).first() if limits else {}
    return [c for c in columns if sure.get(c) or (c in limits and found[c])]


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Hold a column within its physical bounds if it has any quartile outlier.

    The quartiles only decide whether a column is clipped; a column without an
    outlier keeps even values outside the bounds.
    """
    bounds = {c: b for c, b in (bounds or PHYSICAL_BOUNDS).items() if c in df.columns}
    hits = columns_with_outliers(df, list(bounds))
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(bounds[c][1])), F.lit(bounds[c][0])))
            for c in hits
        }
    )


def remove_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop quartile outliers column after column, each on the rows still left."""
    for c in columns or list(PHYSICAL_BOUNDS):
        if c in df.columns:
            limits = iqr_limits(df, [c])
            if c in limits:
                df = df.filter(~_outside(c, limits[c]))
    return df


def handle_outliers(df: DataFrame, strategy: str = "clip") -> DataFrame:
    if strategy not in ("clip", "remove"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return clip_outliers(df) if strategy == "clip" else remove_outliers(df)


def fill_remaining(
    df: DataFrame, order: list[str], by: list[str] = (), block_rows: int | None = None, index: str | None = None,
) -> DataFrame:
    """Numeric nulls take the next value in order, then 0."""
    gaps = columns_with_nulls(df, [c for c in numeric_columns(df) if c not in (*order, index)])
    return fill_next(df, gaps, order, by, block_rows, index=index)


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))
