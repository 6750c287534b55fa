"""From raw readings to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import with_calendar
from gridloom.functions.energy import with_energy
from gridloom.operators.clean import clean_basic, fill_remaining, handle_missing, handle_outliers
from gridloom.operators.encode import label_encode
from gridloom.operators.profile import summary
from gridloom.operators.windows import with_lag_features
from gridloom.session import materialize
from gridloom.sources.readings import read_processed, write_processed

_INDEX = "_row"


def build_features(
    df: DataFrame, ts: str = "datetime", key: str = "reading_id", by: list[str] = (), strategy: str = "clip",
    block_rows: int | None = None,
) -> DataFrame:
    """Clean, impute, clip, derive, encode, fill.

    The readings are sorted and numbered once; gap filling, lags and the last
    fill reuse that position. ``key`` breaks ties of ``ts`` and is unique;
    raw readings without it get one, a hash of the distinct row. Rows that
    differ in the key alone are duplicates. With ``by`` (say ``["city"]``)
    order-dependent steps stay within the key.
    """
    by, order = list(by), [ts, key]
    own = key in df.columns
    if not own:
        df = df.dropDuplicates()
        df = df.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    rows = clean_basic(df, by + order, _INDEX, key if own else None)
    rows = handle_missing(rows, ts, order, by, block_rows, _INDEX)
    if strategy == "remove":
        rows = materialize(rows, "imputed")
        # Removing rows breaks the numbering: number the rows that stay.
        rows = clean_basic(handle_outliers(rows.drop(_INDEX), strategy), by + order, _INDEX)
    else:
        rows = handle_outliers(materialize(rows, "imputed"), strategy)
    # Lags move and sort the rows: what follows from a row alone comes after them.
    names = with_energy(with_calendar(rows, ts)).columns
    rows = with_energy(with_calendar(with_lag_features(rows, order, by, block_rows, _INDEX), ts))
    rows = rows.select(*names, *[c for c in rows.columns if c not in names])
    rows = materialize(label_encode(rows), "features")
    return fill_remaining(rows, order, by, block_rows, _INDEX).drop(_INDEX)


def run(df: DataFrame, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Build, write, and profile what was written (one row per column)."""
    built = build_features(df, **options)
    write_processed(built, path, fmt)
    return summary(read_processed(df.sparkSession, path, fmt, built.schema))
