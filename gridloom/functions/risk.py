"""Rule-based risk score, risk levels and map classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rounding import exact_half_even
from gridloom.schema import MAP_RISK, NO_EVENT, NOMINAL_FREQUENCY, NOMINAL_VOLTAGE, RISK_LABELS, SCORE_LEVELS


def graded(value: Column, steps) -> Column:
    """First label whose lower limit the value reaches; steps run downwards."""
    *upper, (_, lowest) = steps
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in upper:
        out = out.when(value >= F.lit(limit), F.lit(label))
    return out.otherwise(F.lit(lowest))


def _right_closed(value: Column, outputs) -> Column:
    out = F.when(value <= -1, F.lit(None))
    for upper, label in outputs:
        out = out.when(value <= upper, F.lit(label))
    return out


def risk_label(risk: Column) -> Column:
    """Label of a 0..100 risk, upper limits included; null outside the range."""
    return _right_closed(risk, RISK_LABELS)


def risk_rank(risk: Column) -> Column:
    """Order of the label, 0 for the lowest."""
    return _right_closed(risk, [(upper, i) for i, (upper, _) in enumerate(RISK_LABELS)])


def map_label(risk_pct: Column) -> Column:
    return graded(risk_pct, [(limit, label) for limit, label, _ in MAP_RISK])


def map_color(risk_pct: Column) -> Column:
    return graded(risk_pct, [(limit, color) for limit, _, color in MAP_RISK])


def map_radius(risk_pct: Column) -> Column:
    return F.lit(10.0) + risk_pct / F.lit(6.0)


def scenario_color(probability_pct: Column) -> Column:
    return graded(probability_pct, [(75, "#E63946"), (50, "#E9C46A"), (0, "#2A9D8F")])


def overload_marker(overload_pct: Column) -> Column:
    return F.when(overload_pct > 15, "red").when(overload_pct > 8, "orange").otherwise("blue")


def overload_count(overload_pct: Column, n_readings: Column) -> Column:
    return (overload_pct * n_readings / F.lit(100.0)).cast("long")


def floored_ratio(load: Column, available: Column) -> Column:
    """Load ratio of the scoring rule: available power counts as 1 at least."""
    return load / F.greatest(available, F.lit(1.0))


def scoring_stress(ratio_: Column, transformer: Column, voltage: Column, frequency: Column) -> Column:
    """Stress of the scoring rule, 0..1 for readings within physical limits."""
    return (
        F.lit(0.40) * F.least(ratio_, F.lit(2.0)) / F.lit(2.0)
        + F.lit(0.30) * (transformer / F.lit(120.0))
        + F.lit(0.15) * (F.abs(voltage - F.lit(NOMINAL_VOLTAGE)) / F.lit(40.0))
        + F.lit(0.15) * (F.abs(frequency - F.lit(NOMINAL_FREQUENCY)) / F.lit(3.0))
    )


def risk_score(risk: Column, ratio_: Column, stress: Column, transformer: Column, event: Column) -> Column:
    """Probability of a blackout in 0..1; an event in town raises it by 15 %."""
    quiet = event.isNull() | event.isin("", NO_EVENT)
    base = (
        F.coalesce(risk, F.lit(50.0)) / F.lit(100.0) * F.lit(0.35)
        + F.least(ratio_, F.lit(2.0)) / F.lit(2.0) * F.lit(0.30)
        + stress * F.lit(0.20)
        + transformer / F.lit(120.0) * F.lit(0.15)
    )
    return F.least(base * F.when(quiet, F.lit(1.0)).otherwise(F.lit(1.15)), F.lit(1.0))


def score_level(score: Column) -> Column:
    return graded(score, SCORE_LEVELS)


def with_risk_score(df: DataFrame) -> DataFrame:
    """Append the six outputs of the rule; works on batch and streaming frames.

    ``event`` and ``outage_risk`` may be missing from the input.
    """
    event = F.col("event") if "event" in df.columns else F.lit(None).cast("string")
    risk = F.col("outage_risk").cast("double") if "outage_risk" in df.columns else F.lit(None).cast("double")
    load, available = F.col("total_load_mw").cast("double"), F.col("available_power_mw").cast("double")
    heat = F.col("transformer_temp").cast("double")
    staged = df.withColumn("_ratio", floored_ratio(load, available)).withColumn(
        "_stress", scoring_stress(F.col("_ratio"), heat, F.col("voltage"), F.col("frequency"))
    )
    staged = staged.withColumn("_score", risk_score(risk, F.col("_ratio"), F.col("_stress"), heat, event))
    score = F.col("_score")
    return staged.withColumns(
        {
            "prediction": (score >= 0.5).cast("int"),
            "probability_pct": exact_half_even(score * 100, 2),
            "risk_level": score_level(score),
            "load_ratio": exact_half_even(F.col("_ratio"), 3),
            "power_margin_mw": exact_half_even(available - load, 1),
            "grid_stress_pct": exact_half_even(F.col("_stress") * 100, 2),
        }
    ).drop("_ratio", "_stress", "_score")
