"""Fixture tables, SQL fragments and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The readings table made from events and the customer, nation, region tables."""
    e = table(spark, sf_dir, "events") if events is None else events
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = (
        e.join(c, e.user_id == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    eid, uid, value, ts = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("ts")
    available = ((eid * 37) % 500).cast("double")
    return joined.select(
        eid.alias("reading_id"),
        ts.alias("datetime"),
        F.hour(ts).alias("hour"),
        F.when((F.month(ts) <= 1) & (F.dayofmonth(ts) <= 10), "S1")
        .when(F.dayofmonth(ts) <= 20, "S2").otherwise("S3").alias("season"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.col("event_type").alias("event"),
        value.alias("total_load_mw"),
        available.alias("available_power_mw"),
        ((eid * 13) % 60).cast("double").alias("renewable_power_mw"),
        (value * 0.5).alias("industrial_load"),
        (value * 0.3).alias("residential_load"),
        (value * 0.2).alias("commercial_load"),
        (20 + (eid * 7) % 100).cast("double").alias("transformer_temp"),
        (180 + (eid * 11) % 81).cast("double").alias("voltage"),
        ((470 + (eid * 17) % 61) / F.lit(10.0)).alias("frequency"),
        (15 + (eid * 19) % 36).cast("double").alias("temperature"),
        ((eid * 23) % 101).cast("double").alias("humidity"),
        ((eid * 29) % 101).cast("double").alias("outage_risk"),
        ((uid * 31) % 4000).alias("population_density"),
        ((uid * 41) % 900).alias("smart_meter_count"),
        F.when(value > 100, value - 100).otherwise(F.lit(0.0)).alias("load_shedding_mw"),
        (50 + (eid * 3) % 40).cast("double").alias("energy_price"),
        (500 + (eid * 5) % 90).cast("double").alias("fuel_cost"),
        F.when((F.col("event_type") == "error") & (value > 60), 1).otherwise(0).alias("blackout"),
        F.when(value > available, 1).otherwise(0).alias("overload"),
    )


READINGS_SQL = """
  select e.event_id as reading_id, e.ts as datetime, cast(hour(e.ts) as integer) as hour,
    case when month(e.ts) <= 1 and day(e.ts) <= 10 then 'S1' when day(e.ts) <= 20 then 'S2' else 'S3' end as season,
    r.r_name as region, n.n_name as city, e.event_type as event, e.value as total_load_mw,
    cast((e.event_id*37)%500 as double) as available_power_mw,
    cast((e.event_id*13)%60 as double) as renewable_power_mw,
    e.value*0.5::double as industrial_load, e.value*0.3::double as residential_load, e.value*0.2::double as commercial_load,
    cast(20+(e.event_id*7)%100 as double) as transformer_temp,
    cast(180+(e.event_id*11)%81 as double) as voltage,
    (470+(e.event_id*17)%61)/10.0::double as frequency,
    cast(15+(e.event_id*19)%36 as double) as temperature,
    cast((e.event_id*23)%101 as double) as humidity,
    cast((e.event_id*29)%101 as double) as outage_risk,
    cast((e.user_id*31)%4000 as bigint) as population_density,
    cast((e.user_id*41)%900 as bigint) as smart_meter_count,
    case when e.value > 100 then e.value-100 else 0.0::double end as load_shedding_mw,
    cast(50+(e.event_id*3)%40 as double) as energy_price,
    cast(500+(e.event_id*5)%90 as double) as fuel_cost,
    case when e.event_type = 'error' and e.value > 60 then 1 else 0 end as blackout,
    case when e.value > cast((e.event_id*37)%500 as double) then 1 else 0 end as overload
  from events e
  join customer c on e.user_id = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
"""

# Readings with holes: numbers and categories missing by rule.
HOLES = {
    "temperature": 17, "voltage": 11, "total_load_mw": 7, "outage_risk": 5, "season": 19, "event": 13,
}


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir)
    return df.withColumns({c: F.when(F.col("reading_id") % m != 0, F.col(c)) for c, m in HOLES.items()})


GAPPY_SQL = "select * replace ({}) from grid_readings".format(
    ", ".join(f"case when reading_id % {m} <> 0 then {c} end as {c}" for c, m in HOLES.items())
)


def with_sql(body: str, **ctes: str) -> str:
    """Put the readings (and further tables) in front of a query."""
    parts = [f"grid_readings as ({READINGS_SQL})"] + [f"{k} as ({v})" for k, v in ctes.items()]
    return "with " + ",\n".join(parts) + "\n" + body


def up(expr: str, digits: int = 2) -> str:
    """Round half up on the decimal value."""
    return f"cast(round(cast(cast({expr} as double) as decimal(38,{digits + 7})), {digits}) as double)"


def even(expr: str, digits: int = 6) -> str:
    """Round half to even on the decimal value."""
    return f"cast(round_even(cast(cast({expr} as double) as decimal(38,{digits + 7})), {digits}) as double)"


def total(column: str) -> str:
    return f"cast(sum({column}) as bigint)"
