"""Per-row energy indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rounding import half_up, ratio
from gridloom.schema import NOMINAL_FREQUENCY, NOMINAL_VOLTAGE


def power_margin(load: str = "total_load_mw", available: str = "available_power_mw") -> Column:
    return F.col(available) - F.col(load)


def load_ratio(load: str = "total_load_mw", available: str = "available_power_mw") -> Column:
    """Load over available power, null without available power."""
    return ratio(F.col(load), F.col(available))


def share(part: str, whole: str, scale: float = 1.0) -> Column:
    quotient = ratio(F.col(part), F.col(whole))
    return quotient if scale == 1.0 else quotient * F.lit(scale)


def deviation(column: str, nominal: float) -> Column:
    return F.abs(F.col(column) - F.lit(nominal))


def feature_stress(load_ratio_: Column, transformer: Column, volt_dev: Column, freq_dev: Column) -> Column:
    """Stress index used as a model feature; the load ratio is held in 0..2."""
    held = F.when(load_ratio_.isNotNull(), F.greatest(F.least(load_ratio_, F.lit(2.0)), F.lit(0.0)))
    return (
        F.lit(0.4) * held
        + F.lit(0.3) * (transformer / F.lit(100.0))
        + F.lit(0.15) * (volt_dev / F.lit(20.0))
        + F.lit(0.15) * (freq_dev / F.lit(3.0))
    )


def deficit(load: str = "total_load_mw", available: str = "available_power_mw") -> Column:
    return half_up(F.col(load) - F.col(available), 2)


def with_energy(df: DataFrame) -> DataFrame:
    """Add margin, shares, ratio, deviations and the stress index."""
    return df.withColumns(
        {
            "power_margin": power_margin(),
            "power_margin_pct": ratio(power_margin(), F.col("available_power_mw")) * F.lit(100.0),
            "renewable_share": share("renewable_power_mw", "available_power_mw", 100.0),
            "industrial_share": share("industrial_load", "total_load_mw"),
            "residential_share": share("residential_load", "total_load_mw"),
            "commercial_share": share("commercial_load", "total_load_mw"),
            "load_ratio": load_ratio(),
            "voltage_deviation": deviation("voltage", NOMINAL_VOLTAGE),
            "frequency_deviation": deviation("frequency", NOMINAL_FREQUENCY),
        }
    ).withColumn(
        "grid_stress_index",
        feature_stress(
            F.col("load_ratio"), F.col("transformer_temp"),
            F.col("voltage_deviation"), F.col("frequency_deviation"),
        ),
    )
