"""Reading and writing the readings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.energy import load_ratio, power_margin
from gridloom.schema import RAW_SCHEMA


def read_csv(spark: SparkSession, path: str, schema=RAW_SCHEMA) -> DataFrame:
    """CSV with a header; the schema is given, so no pass is spent on inferring it.

    Columns are matched by name, in whatever order the header has them; all
    files of a folder share one header. Further columns are not read; a column
    that the header lacks is an error.
    """
    header = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f for f in schema.fields}
    if absent := [name for name in kinds if name not in header]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    in_order = T.StructType([kinds.get(name, T.StructField(name, T.StringType())) for name in header])
    return spark.read.schema(in_order).option("header", True).csv(path).select(*kinds)


_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop_path)


def fill_derived(df: DataFrame) -> DataFrame:
    """Add date, load ratio and power margin where the source lacks them."""
    wanted = {"date": F.to_date("datetime"), "load_ratio": load_ratio(), "power_margin": power_margin()}
    return df.withColumns({name: expr for name, expr in wanted.items() if name not in df.columns})


def load_readings(
    spark: SparkSession,
    table: str | None = "grid_readings",
    processed: str | None = None,
    raw: str | None = None,
    processed_format: str = "parquet",
) -> DataFrame:
    """First source that exists: catalog table, processed table, raw CSV."""
    if table and spark.catalog.tableExists(table):
        return fill_derived(spark.table(table))
    if processed and exists(spark, processed):
        return fill_derived(read_processed(spark, processed, processed_format))
    if raw and exists(spark, raw):
        return fill_derived(read_csv(spark, raw))
    raise FileNotFoundError(f"no readings in table {table!r}, {processed!r} or {raw!r}")


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table that ``write_processed`` made. A CSV without a schema has its types inferred, at the price of a pass."""
    if fmt != "csv":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("timestampNTZFormat", _MICROS)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True).option("preferDate", True)).csv(path)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """Write the feature table partitioned by year and month.

    Rows are rebalanced by month: adaptive planning cuts a large month into
    tasks of the advisory size and puts small ones together.
    """
    if fmt == "csv":
        # The default text form of a timestamp ends at milliseconds.
        text = df.write.mode("overwrite").option("header", True)
        text.option("timestampNTZFormat", _MICROS).csv(path)
        return
    out = df.hint("rebalance", "year", "month").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    out.partitionBy("year", "month").parquet(path)
