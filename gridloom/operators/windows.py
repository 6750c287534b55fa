"""Lags and rolling statistics by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.ordered import bounded_windows
from gridloom.schema import LAGS, ROLLING


def lag(column: str, rows: int, window: WindowSpec) -> Column:
    return F.lag(column, rows).over(window)


def rolling(column: str, rows: int, window: WindowSpec) -> dict[str, Column]:
    """Mean, deviation and maximum of the current and the ``rows - 1`` rows before it.

    One row alone has deviation 0.
    """
    frame = window.rowsBetween(-(rows - 1), 0)
    return {
        "mean": F.avg(column).over(frame),
        "std": F.coalesce(F.stddev_samp(column).over(frame), F.lit(0.0)),
        "max": F.max(column).over(frame),
    }


def full_rolling_mean(column: str, rows: int, window: WindowSpec) -> Column:
    """Mean of the last ``rows`` rows, null until that many values exist."""
    frame = window.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))


def centred_mean(column: str, period: int, window: WindowSpec) -> Column:
    """Mean over one even period with half weight on both ends, null near the edges."""
    half = period // 2
    left, right = window.rowsBetween(-half, half - 1), window.rowsBetween(-(half - 1), half)
    whole = F.count(column).over(window.rowsBetween(-half, half)) == 2 * half + 1
    return F.when(whole, (F.sum(column).over(left) + F.sum(column).over(right)) / F.lit(2.0 * period))


def lag_feature_columns(window: WindowSpec, load: str = "total_load_mw", risk: str = "outage_risk") -> dict[str, Column]:
    """The ten lag and nine rolling columns of the feature table."""
    out = {}
    for rows in LAGS:
        out[f"load_lag_{rows}h"] = lag(load, rows, window)
        out[f"outage_risk_lag_{rows}h"] = lag(risk, rows, window)
    for rows in ROLLING:
        stats = rolling(load, rows, window)
        out[f"load_roll_mean_{rows}h"] = stats["mean"]
        out[f"load_roll_std_{rows}h"] = stats["std"]
        out[f"risk_roll_max_{rows}h"] = rolling(risk, rows, window)["max"]
    return out


def with_lag_features(
    df: DataFrame, order: list[str], by: list[str] = (), block_rows: int | None = None, index: str | None = None,
) -> DataFrame:
    """Add the lag and rolling columns; ``by=[]`` runs over the whole table in order."""
    return bounded_windows(df, order, lag_feature_columns, by, before=24, block_rows=block_rows, index=index)


def lag_matrix(
    df: DataFrame, column: str, order: list[str], by: list[str] = (), lags: int = 24, horizon: int = 6,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows (order..., lags, target): the ``lags`` values before each target.

    The last ``horizon - 1`` possible targets are left out, so a series of n
    points gives n - lags - horizon + 1 rows.
    """

    def columns(window: WindowSpec) -> dict[str, Column]:
        behind = window.rowsBetween(-lags, -1)
        ahead = window.rowsBetween(1, horizon - 1) if horizon > 1 else None
        return {
            "lags": F.collect_list(column).over(behind),
            "_left": F.count(F.lit(1)).over(ahead) if ahead else F.lit(0),
        }

    wide = bounded_windows(df.select(*by, *order, column), order, columns, by, lags, max(horizon - 1, 0), block_rows)
    return (
        wide.filter((F.size("lags") == lags) & (F.col("_left") == horizon - 1))
        .select(*by, *order, "lags", F.col(column).alias("target"))
    )
