"""City and region coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.schema import CITY_COORDS, DEFAULT_COORDS, REGION_CENTROIDS


def city_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CITY_COORDS), "city string, lat double, lon double")


def region_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_CENTROIDS), "region string, lat double, lon double")


def with_coordinates(df: DataFrame, places: DataFrame | None = None, key: str = "city") -> DataFrame:
    """Look up coordinates; unknown places take the default point.

    Only the built-in list of seven cities is broadcast by name.
    """
    places = places if places is not None else F.broadcast(city_dimension(df.sparkSession))
    lat, lon = DEFAULT_COORDS
    return df.join(places, key, "left").withColumns(
        {"lat": F.coalesce("lat", F.lit(lat)), "lon": F.coalesce("lon", F.lit(lon))}
    )


def jittered_points(stats: DataFrame, key: str = "city", per: int = 50, spread: float = 0.15, seed: int = 42) -> DataFrame:
    """Heat-map points: one per ``per`` blackouts of a place (one at least), scattered around it.

    The noise depends on place, point number and seed only, so it is the same
    in every run and on every partitioning.
    """
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_blackouts") / per))
    chunk = 10_000  # points one task makes from one row
    chunks = stats.withColumns({"_n": n, "_chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk)))})
    first = F.col("_chunk") * chunk + 1
    points = chunks.repartition(key, "_chunk").withColumn(
        "point", F.explode(F.sequence(first, F.least(F.col("_n"), first + (chunk - 1))))
    )

    def uniform(tag: str):
        """From 52 bits of an MD5, which any SQL engine gives; never 0 or 1."""
        text = F.concat_ws(":", F.col(key).cast("string"), F.col("point").cast("string"), F.lit(f"{tag}:{seed}"))
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
        return (bits + 0.5) / F.lit(float(1 << 52))

    # Two independent normal values from two uniform ones (Box-Muller).
    radius = F.sqrt(-2 * F.log(uniform("r")))
    angle = 2 * F.pi() * uniform("a")
    return points.select(
        key, "point",
        (F.col("lat") + spread * radius * F.cos(angle)).alias("lat"),
        (F.col("lon") + spread * radius * F.sin(angle)).alias("lon"),
        (F.col("blackout_pct") / 100).alias("weight"),
    )
