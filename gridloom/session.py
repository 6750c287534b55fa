"""Session and shared scratch storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "gridloom") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it.

    Only a local session without the setting gets a folder of its own: on a
    cluster, one on a single machine too, a machine-local folder would be
    invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    The copy cuts the lineage and survives the loss of any executor; unlike a
    row checkpoint it is columnar, so later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """At least one partition per core, for CPU-bound work on a table of few files.

    A table of as many files, as on a cluster, is returned as it is. Only the
    file list is asked: nothing of the table is computed. Pass a written table.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if len(table.inputFiles()) >= cores else table.repartition(cores)


#: Rows up to which a counted table is sent to all tasks of a join.
SMALL_ROWS = 100_000


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if it has few rows, for joins that must not move the other side.

    The table is counted first; a larger one is left to the planner.
    """
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table
