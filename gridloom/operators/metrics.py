"""Quality of predictions, each table in one aggregation."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rounding import half_even


def _or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact area: Spark sorts the distinct scores over all tasks, without bins."""
    pairs = df.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    return BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(pairs)


def classification_metrics(
    df: DataFrame, label: str, prediction: str, score: str | None = None, digits: int = 4,
) -> DataFrame:
    """Accuracy, precision, recall, F1, MCC, confusion matrix and, with a score, ROC-AUC."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    shown = {
        "accuracy": _or_zero(tp + tn, tp + fp + fn + tn),
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1_score": _or_zero(2 * tp, 2 * tp + fp + fn),
        "mcc": _or_zero(
            tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
        ),
    }
    out = counts.select(
        *[half_even(e, digits).alias(n) for n, e in shown.items()],
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )
    if score:
        out = out.withColumn("roc_auc", half_even(F.lit(roc_auc(df, label, score)), digits))
    return out


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = (), digits: int = 4,
) -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE, over the table or per key."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("_var"),
        (F.avg(F.abs(e) / (F.abs(y) + 1e-9)) * 100).alias("mape"),
    )
    shown = {
        "mae": F.col("mae"), "mse": F.col("mse"), "rmse": F.sqrt("mse"),
        "r2": 1 - F.try_divide("mse", "_var"), "mape": F.col("mape"),
    }
    return sums.select(*by, *[half_even(v, digits).alias(n) for n, v in shown.items()])
