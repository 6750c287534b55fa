"""Profiling: shape, nulls, duplicates, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.rounding import half_even
from gridloom.operators.quantiles import quantiles


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, in one aggregation.

    Equal rows meet already in the map-side combine, so a large set of copies
    reaches the shuffle as one row per task.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: type, null count and null share."""
    spark = df.sparkSession
    counted = df.agg(
        F.count("*").alias("_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.sum(F.col(f"`{f.name}`").isNull().cast("long")).alias("missing"),
                )
                for f in df.schema.fields
            ]
        ).alias("_cols"),
    )
    return counted.select("_rows", F.inline("_cols")).select(
        "column", "dtype", F.coalesce("missing", F.lit(0)).alias("missing"),
        half_even(F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), F.lit(0.0)), 2).alias("missing_pct"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    return null_counts(df).filter(F.col("missing") > 0).select("column", "missing", "missing_pct")


def summary(df: DataFrame) -> DataFrame:
    """Column table of ``null_counts`` with the row, column and duplicate counts.

    One aggregation over grouped equal rows gives everything: each distinct
    row carries its number of copies.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    w = F.col("_copies")
    counted = copies.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(w - 1), F.lit(0)).alias("duplicates"),
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.coalesce(F.sum(F.when(F.col(f"`{f.name}`").isNull(), w)), F.lit(0)).alias("missing"),
                )
                for f in df.schema.fields
            ]
        ).alias("_cols"),
    )
    return counted.select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "duplicates", F.inline("_cols")
    ).withColumn(
        "missing_pct",
        half_even(F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("n_rows")), F.lit(0.0)), 2),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    columns = columns or numeric_columns(df)
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in columns
            ]
        ).alias("_cols")
    ).select(F.inline("_cols"))
    quarts = quantiles(df, columns, [0.25, 0.5, 0.75])
    table = moments.join(quarts, "column", "left")
    q = F.col("quantiles")
    shown = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"),
             "p25": q[0], "p50": q[1], "p75": q[2], "max": F.col("max")}
    return table.select("column", "count", *[half_even(e, digits).alias(n) for n, e in shown.items()])


def value_shares(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """Share of each value among the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select(column, "n", half_even(F.col("n") / total, digits).alias("share"))


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct non-null values per column.

    Counted from the distinct (column, value) pairs, so no task holds a set.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    ).select("p.*").filter(F.col("value").isNotNull())
    return pairs.distinct().groupBy("column").agg(F.count("*").alias("n_unique"))


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
        .select(F.lit(column).alias("column"), "value", "n")
    )


def coverage(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """First and last timestamp and the whole days between them."""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).withColumn(
        "days", F.extract(F.lit("DAY"), F.col("last_ts") - F.col("first_ts")).cast("long")
    )


def domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value")


def filter_domains(df: DataFrame) -> DataFrame:
    """Choices of the region, city and season filters as one table."""
    out = None
    for column in ("region", "city", "season"):
        part = domain(df, column).select(F.lit(column).alias("filter"), "value")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("filter", "value")


def date_range(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.agg(F.to_date(F.min(ts)).alias("date_min"), F.to_date(F.max(ts)).alias("date_max"))
