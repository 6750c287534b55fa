"""Scoring of arriving readings. The rule needs no state, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridloom.functions.calendar import with_calendar
from gridloom.functions.energy import with_energy
from gridloom.functions.risk import with_risk_score


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(readings: DataFrame, ts: str = "datetime") -> DataFrame:
    """Calendar and energy columns and the risk score; the same for batch and stream.

    The score's ``load_ratio`` (available power of 1 at least) takes the place
    of the feature of that name.
    """
    return with_risk_score(with_energy(with_calendar(readings, ts)))


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the input is used up; a restart resumes from the checkpoint."""
    return (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
