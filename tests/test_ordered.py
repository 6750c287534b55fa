import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import ordered, quantiles, sampling, windows


def _rows(spark, n=3000, hot=0.4):
    """Rows of which a large part shares one key and one timestamp."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("id"),
        F.when(i < n * hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("key"),
        F.when(i % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).otherwise(
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 37 % 5000).cast("int"))).alias("ts"),
        F.when((i * 13 % 11 < 4) | ((i > 500) & (i < 900)) | (i % 3 == 0), F.lit(None)).otherwise((i * 17 % 101).cast("double")).alias("x"),
    )


ORDER = ["ts", "id"]


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("block", [50, 700])
def test_bounded_windows_equal_plain_window(spark, by, block):
    df = _rows(spark)
    plain = Window.partitionBy(*by).orderBy(*ORDER)
    cols = lambda w: {"a": F.lag("x", 24).over(w), "b": F.max("x").over(w.rowsBetween(-23, 0)), "c": F.count("x").over(w.rowsBetween(-5, 7))}
    ours = ordered.bounded_windows(df, ORDER, cols, by, 24, 7, block).select("id", "a", "b", "c")
    theirs = df.withColumns(cols(plain)).select("id", "a", "b", "c")
    assert ours.count() == 3000 and ours.exceptAll(theirs).count() == 0


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("block", [50, 700])
def test_fills_equal_plain_window(spark, by, block):
    df = _rows(spark)
    w = Window.partitionBy(*by).orderBy(*ORDER)
    ours = ordered.fill_next(df, ["x"], ORDER, by, block, last_resort=None).select("id", "x")
    theirs = df.select("id", F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("x"))
    assert ours.exceptAll(theirs).count() == 0 and ours.count() == 3000
    line = ordered.interpolate_time(df, ["x"], "ts", ORDER, by, block).toPandas().set_index("id")["x"]
    pdf = df.toPandas().sort_values(ORDER)
    groups = [g for _, g in pdf.groupby("key")] if by else [pdf]
    for g in groups:
        known = g.dropna(subset=["x"])
        t = g["ts"].astype("int64").to_numpy()
        tk, xk = known["ts"].astype("int64").to_numpy(), known["x"].to_numpy()
        for tt, rid, x in zip(t, g["id"], g["x"]):
            if pd.notna(x):
                assert line[rid] == x
            elif (tk != tt).all():
                assert line[rid] == pytest.approx(np.interp(tt, tk, xk), abs=1e-9)


def test_running_totals(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 2003).alias("k"), (F.col("id") % 10).alias("v"))
    ours = ordered.running_totals(df, ["k"], {"t": F.col("v")}, 90)
    theirs = df.withColumn("t", F.sum("v").over(Window.orderBy("k")))
    assert ours.exceptAll(theirs).count() == 0 and ours.count() == 2000


def test_number_rows_is_stable(spark):
    numbered = ordered.number_rows(_rows(spark), ORDER)
    first = numbered.orderBy("id").collect()
    assert first == numbered.orderBy("id").collect()
    assert sorted(r["row_index"] for r in first) == list(range(3000))


@pytest.mark.parametrize("limit", [50, 10_000])
def test_quantiles_exact_with_ties(spark, limit):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 7919 % 10_007 / 10.0).alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise("b").alias("g"))
    probs = [0.0, 0.05, 0.3333, 0.34, 0.5, 0.95, 1.0]
    pdf = df.toPandas()
    got = quantiles.quantiles(df, ["x"], probs, in_memory_rows=limit).first()["quantiles"]
    assert got == pytest.approx(np.quantile(pdf["x"], probs), abs=1e-12)
    rows = {r["g"]: r["quantiles"] for r in quantiles.quantiles(df, ["x"], probs, ("g",), limit).collect()}
    assert len(rows) == 3
    for g, part in pdf.groupby("g", dropna=False):
        assert rows[None if pd.isna(g) else g] == pytest.approx(np.quantile(part["x"], probs), abs=1e-12)


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(5003).select("id", (F.col("id") % 37 == 0).cast("int").alias("y"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    train, test = sampling.stratified_split(df, "id", "y", in_memory_rows=100)
    assert test.count() == 1001 and train.count() == 4002
    share = test.filter("y = 1").count() / df.filter("y = 1").count()
    assert abs(share - 0.2) < 0.01
    assert test.exceptAll(sampling.stratified_split(df.repartition(3), "id", "y")[1]).count() == 0
    # All rows share one time: the tie-breaker decides.
    train, test = sampling.chronological_split(df, "ts", "id", in_memory_rows=100)
    assert train.count() == 4002 and train.agg(F.max("id")).first()[0] == 4001


def test_lag_matrix_rows(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v"))
    out = windows.lag_matrix(df, "v", ["id"], block_rows=31).orderBy("id").collect()
    assert len(out) == 100 - 24 - 6 + 1
    assert out[0]["target"] == 24.0 and out[0]["lags"] == [float(i) for i in range(24)]


def test_rolling_one_row_has_zero_deviation(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, total_load_mw double").withColumn("outage_risk", F.lit(1.0))
    row = windows.with_lag_features(df, ["id"]).first()
    assert row["load_roll_std_3h"] == 0.0 and row["load_roll_mean_24h"] == 5.0 and row["load_lag_1h"] is None
