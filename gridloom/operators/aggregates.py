"""Grouped tables behind the exploration and dashboard views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.risk import map_color, map_label, map_radius, overload_count, overload_marker
from gridloom.functions.rounding import half_even
from gridloom.operators.places import with_coordinates
from gridloom.operators.products import product_sums, shifts
from gridloom.operators.quantiles import quantiles
from gridloom.session import small


def rate_by(df: DataFrame, key: str, flag: str, digits: int = 2) -> DataFrame:
    """Share of flagged rows per key, in percent."""
    return (
        df.groupBy(key)
        .agg(F.sum(flag).alias("flagged"), F.count(flag).alias("total"))
        .withColumn("rate_pct", half_even(F.col("flagged") / F.col("total") * 100, digits))
        .orderBy("rate_pct", key)
    )


def mean_by(df: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    return df.groupBy(key).agg(half_even(F.avg(value), digits).alias(f"mean_{value}")).orderBy(key)


def risk_by_hour(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.groupBy("hour").agg(
        half_even(F.avg("outage_risk"), digits).alias("risk"), F.sum("blackout").alias("blackouts")
    ).orderBy("hour")


def load_by_month(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.groupBy(F.month("datetime").alias("month")).agg(
        half_even(F.avg("total_load_mw"), digits).alias("mean"),
        F.max("total_load_mw").alias("max"),
        F.min("total_load_mw").alias("min"),
    ).orderBy("month")


def total_by(df: DataFrame, key: str, value: str, digits: int = 6) -> DataFrame:
    return df.groupBy(key).agg(half_even(F.sum(value), digits).alias(f"total_{value}")).orderBy(f"total_{value}", key)


def event_statistics(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.groupBy("event").agg(
        F.count("event").alias("n"),
        half_even(F.avg("total_load_mw"), digits).alias("avg_load"),
        half_even(F.avg("outage_risk"), digits).alias("avg_risk"),
        half_even(F.avg("blackout"), digits).alias("blackout_rate"),
        half_even(F.avg("load_shedding_mw"), digits).alias("avg_shedding"),
    ).orderBy(F.desc("avg_risk"), "event")


def region_statistics(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.groupBy("region").agg(
        half_even(F.avg("outage_risk"), digits).alias("avg_risk"),
        F.sum("blackout").alias("blackouts"),
        F.sum("overload").alias("overloads"),
    ).orderBy("region")


def city_statistics(df: DataFrame) -> DataFrame:
    """Seven measures per city with coordinates, as the maps need them."""
    stats = df.groupBy("city").agg(
        F.count("city").alias("n_readings"),
        half_even(F.avg("blackout"), 3).alias("blackout_rate"),
        half_even(F.avg("outage_risk"), 3).alias("avg_risk"),
        half_even(F.sum("load_shedding_mw"), 3).alias("total_shedding"),
        half_even(F.avg("total_load_mw"), 3).alias("avg_load"),
        half_even(F.avg("overload"), 3).alias("overload_rate"),
        F.sum("blackout").alias("n_blackouts"),
    )
    return with_coordinates(
        stats.withColumns(
            {
                "blackout_pct": half_even(F.col("blackout_rate") * 100, 2),
                "overload_pct": half_even(F.col("overload_rate") * 100, 2),
            }
        )
    )


def risk_zones(df: DataFrame) -> DataFrame:
    """Circle per city: colour, label and radius by mean risk."""
    risk = F.col("avg_risk")
    return city_statistics(df).withColumns(
        {"color": map_color(risk), "label": map_label(risk), "radius": half_even(map_radius(risk), 3)}
    )


def overload_markers(df: DataFrame) -> DataFrame:
    """Marker per city with overloads: count and colour class."""
    counted = city_statistics(df).withColumns(
        {
            "n_overloads": overload_count(F.col("overload_pct"), F.col("n_readings")),
            "marker": overload_marker(F.col("overload_pct")),
        }
    )
    return counted.filter(F.col("n_overloads") > 0).select("city", "lat", "lon", "overload_pct", "n_overloads", "marker")


def hour_weekday_load(df: DataFrame, digits: int = 6) -> DataFrame:
    """Mean load per hour and weekday; always seven weekday columns."""
    names = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]  # fixed values
    wide = (
        df.withColumn("_dow", F.weekday("datetime"))
        .groupBy("hour")
        .pivot("_dow", list(range(7)))
        .agg(F.avg("total_load_mw"))
    )
    return wide.select("hour", *[half_even(F.col(str(i)), digits).alias(n) for i, n in enumerate(names)]).orderBy("hour")


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pearson coefficient of every pair, in one pass; rows (left, right, corr).

    A pair uses the rows where both values are present.
    """
    columns = [c for c in columns if c in df.columns]
    names = F.array(*[F.lit(c) for c in columns])
    sums = product_sums(df, columns, shifts(df, columns))
    # The sums of the pair (j, i) stand for the other column.
    other = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"), F.col("nan").alias("nan_y"))
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    # A spread that is nothing but rounding is none.
    vx, vy = (F.when(v > 1e-14 * square, v).otherwise(0.0) for v, square in ((vx, F.col("sxx")), (vy, F.col("syy"))))
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(vx * vy))
    r = F.when(n == 0, None).when(F.col("nan") + F.col("nan_y") > 0, F.lit(float("nan"))).when(F.col("i") == F.col("j"), F.when(vx > 0, 1.0)).otherwise(r)
    return sums.join(F.broadcast(other), ["i", "j"]).select(  # columns x columns rows
        names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), half_even(r, digits).alias("corr"))


def ranked_correlations(df: DataFrame, columns: list[str], target: str, rows: int = 10, digits: int = 6) -> DataFrame:
    matrix = correlations(df, columns, digits)
    return (
        matrix.filter(F.col("right") == target)
        .select(F.col("left").alias("column"), "corr")
        .orderBy(F.desc_nulls_last("corr"), "column")
        .limit(rows)
    )


def _extent(df: DataFrame, column: str) -> Column:
    return df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("s")).scalar()


def histogram(df: DataFrame, column: str, bins: int = 50, split: str | None = None) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last bin includes its upper edge.

    A single value takes the bins of the unit range around it.
    """
    ends = _extent(df, column)
    flat = ends["lo"] == ends["hi"]
    lo = F.when(flat, ends["lo"] - 0.5).otherwise(ends["lo"])
    hi = F.when(flat, ends["hi"] + 0.5).otherwise(ends["hi"])
    # The share of the range first, then the bins: in another order, values next to an edge round into the other bin.
    place = (F.col(column).cast("double") - lo) / (hi - lo) * F.lit(float(bins))
    placed = df.filter(F.col(column).isNotNull()).select(
        *([split] if split else []),
        (F.floor(F.least(place, F.lit(bins - 1.0))) + 1).cast("int").alias("bin"),
    )
    counts = placed.groupBy("bin", *([split] if split else [])).agg(F.count("*").alias("n"))
    width = (hi - lo) / F.lit(float(bins))
    return counts.withColumns(
        {
            "bin_from": half_even(lo + (F.col("bin") - 1) * width, 6),
            "bin_to": half_even(lo + F.col("bin") * width, 6),
        }
    ).orderBy("bin", *([split] if split else []))


def binned_rate(df: DataFrame, column: str, flag: str, bins: int = 5, digits: int = 6) -> DataFrame:
    """Flag rate in percent per equal-width bin; bins include their upper edge."""
    ends = _extent(df, column)
    width = (ends["hi"] - ends["lo"]) / F.lit(float(bins))
    place = F.ceil(F.try_divide(F.col(column) - ends["lo"], width))
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), half_even(F.avg(flag) * 100, digits).alias("rate_pct"))
        .orderBy("bin")
    )


def box_summary(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), digits: int = 6, **options) -> DataFrame:
    """Quartiles and the whisker ends inside 1.5 quartile ranges, per group and column."""
    by = tuple(by)
    quarts = quantiles(df, columns, [0.25, 0.5, 0.75], by, **options)
    q = F.col("quantiles")
    limits = quarts.select(
        *by, "column", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[0] - 1.5 * (q[2] - q[0])).alias("_low"), (q[2] + 1.5 * (q[2] - q[0])).alias("_high"),
    )
    long = df.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")
    ).select(*by, "_x.*")
    value = F.col("value")
    keys = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by] + [F.col("l.column") == F.col("r.column")]
    joined = long.alias("l").join(small(limits).alias("r"), reduce(lambda a, b: a & b, keys))
    inside = F.when(value.between(F.col("_low"), F.col("_high")), value)
    return joined.groupBy(*[F.col(f"l.{b}") for b in by], F.col("l.column")).agg(
        F.count(value).alias("n"),
        *[half_even(F.first(c), digits).alias(c) for c in ("q1", "median", "q3")],
        half_even(F.min(inside), digits).alias("whisker_low"),
        half_even(F.max(inside), digits).alias("whisker_high"),
        F.count_if(~value.between(F.col("_low"), F.col("_high"))).alias("n_outside"),
    )


def marker_quantile(df: DataFrame, column: str, p: float, digits: int = 6) -> DataFrame:
    return quantiles(df, [column], [p]).select("column", F.lit(p).alias("p"), half_even(F.col("quantiles")[0], digits).alias("value"))


def _kpi_columns(digits: int) -> list[Column]:
    return [
        half_even(F.avg("blackout") * 100, digits).alias("blackout_rate_pct"),
        half_even(F.avg("outage_risk"), digits).alias("avg_risk"),
        half_even(F.sum("load_shedding_mw"), digits).alias("total_shedding"),
        half_even(F.avg("overload") * 100, digits).alias("overload_rate_pct"),
        half_even(F.avg("total_load_mw"), digits).alias("avg_load"),
        F.sum("blackout").alias("blackouts"),
        F.sum("overload").alias("overloads"),
        F.count("*").alias("n"),
    ]


def kpi_row(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.agg(*_kpi_columns(digits))


def kpi_delta(part: DataFrame, whole: DataFrame, flag: str = "blackout", digits: int = 6) -> DataFrame:
    """Flag rate of a selection, of everything, and their difference in points."""
    overall = whole.agg(F.avg(flag).alias("m")).scalar()
    row = part.agg(F.avg(flag).alias("_m")).withColumn("_all", overall)
    return row.select(
        half_even(F.col("_m") * 100, digits).alias("rate_pct"),
        half_even(F.col("_all") * 100, digits).alias("overall_pct"),
        half_even((F.col("_m") - F.col("_all")) * 100, digits).alias("delta_pct"),
    )


def _arg_max(df: DataFrame, key: str, value: str) -> Column:
    """Key with the largest mean; the smallest key on equal means."""
    means = df.groupBy(key).agg(half_even(F.avg(value), 9).alias("m")).filter(F.col(key).isNotNull())
    return means.orderBy(F.desc("m"), key).limit(1).select(key).scalar()


def project_kpis(df: DataFrame, digits: int = 6) -> DataFrame:
    """Headline figures of the whole table with the riskiest region, hour and season."""
    base = df.agg(
        F.to_date(F.min("datetime")).alias("period_from"),
        F.to_date(F.max("datetime")).alias("period_to"),
        F.count("*").alias("observations"),
        half_even(F.avg("blackout") * 100, digits).alias("blackout_rate_pct"),
        half_even(F.avg("overload") * 100, digits).alias("overload_rate_pct"),
        half_even(F.sum("load_shedding_mw"), digits).alias("total_shedding"),
        half_even(F.avg("total_load_mw"), digits).alias("avg_load"),
        F.max("total_load_mw").alias("max_load"),
        half_even(F.avg("outage_risk"), digits).alias("avg_risk"),
    )
    return base.withColumns(
        {
            "riskiest_region": _arg_max(df, "region", "outage_risk"),
            "riskiest_hour": _arg_max(df, "hour", "blackout"),
            "riskiest_season": _arg_max(df, "season", "blackout"),
            "n_columns": F.lit(len(df.columns)).cast("long"),
        }
    )


def target_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """Count and rate of both targets and the mean risk."""
    return df.agg(
        F.sum("blackout").alias("blackouts"),
        half_even(F.avg("blackout") * 100, digits).alias("blackout_pct"),
        F.sum("overload").alias("overloads"),
        half_even(F.avg("overload") * 100, digits).alias("overload_pct"),
        half_even(F.avg("outage_risk"), digits).alias("avg_risk"),
    )


def anomaly_rates(df: DataFrame, flag: str = "is_anomaly", key: str = "region") -> DataFrame:
    return df.groupBy(key).agg(
        F.sum(flag).alias("n_anomalies"),
        F.count(flag).alias("total"),
        half_even(F.avg(flag) * 100, 2).alias("rate_pct"),
    ).orderBy(key)


def scatter(df: DataFrame, x: str, y: str, color: str = "blackout", size: str | None = None) -> DataFrame:
    return df.select(x, y, color, *([size] if size else []))

