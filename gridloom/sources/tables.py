"""Catalog views and the report registry by name."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.energy import load_ratio
from gridloom.operators.reports import REPORTS

log = logging.getLogger(__name__)

READINGS = "grid_readings"


def blackout_events(df: DataFrame) -> DataFrame:
    return df.filter(F.col("blackout") == 1).select(
        "datetime", "region", "city", "total_load_mw", "available_power_mw",
        "outage_risk", "load_shedding_mw", "event", "temperature",
    )


def overload_events(df: DataFrame) -> DataFrame:
    if "load_ratio" not in df.columns:
        df = df.withColumn("load_ratio", load_ratio())
    return df.filter(F.col("overload") == 1).select(
        "datetime", "region", "city", "total_load_mw", "available_power_mw",
        "load_ratio", "transformer_temp", "voltage", "frequency", "event",
    )


def register(df: DataFrame, persist: bool = False, name: str = READINGS) -> None:
    """Register the readings and their two event views, replacing older ones.

    With ``persist`` the readings become a table in the catalog. They are
    written beside the old table first, so ``df`` may read that table (to extend
    it, say), and then take its place; a reader that has opened the old table
    must ask for it again. A temporary view of that name no longer hides the table.
    """
    if persist:
        spark = df.sparkSession
        staged, old = f"{name}_next_{uuid.uuid4().hex}", f"{name}_old_{uuid.uuid4().hex}"
        df.write.mode("errorifexists").saveAsTable(staged)
        if "." not in name:
            spark.catalog.dropTempView(name)
        there = spark.catalog.tableExists(name)
        if there:
            spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        try:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        except Exception:
            if there:
                spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
            raise
        if there:
            spark.sql(f"DROP TABLE {old}")
        df = spark.table(name)
    else:
        df.createOrReplaceTempView(name)
    blackout_events(df).createOrReplaceTempView("v_blackout_events")
    overload_events(df).createOrReplaceTempView("v_overload_events")


def listing(spark: SparkSession) -> DataFrame:
    """Names of the tables and views in the session, one row each."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"))


def run_report(spark: SparkSession, name: str, table: str = READINGS) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; known: {sorted(REPORTS)}")
    return REPORTS[name](spark.table(table))


def run_all_reports(spark: SparkSession, table: str = READINGS) -> dict[str, DataFrame]:
    """All reports that resolve on the table; the others are logged and left out."""
    out = {}
    for name in REPORTS:
        try:
            out[name] = run_report(spark, name, table)
        except Exception as error:  # a table may lack a column one report needs
            log.error("report %s: %s", name, error)
    return out


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)
