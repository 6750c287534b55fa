import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.base import readings
from gridloom.operators import metrics, models, series

N = 24 * 30


@pytest.fixture(scope="module")
def hourly(spark):
    rng = np.random.default_rng(5)
    t = np.arange(N)
    y = 300 + 0.05 * t + 40 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 6, N)
    walk = np.cumsum(rng.normal(0, 1, N)) + 100
    ts = pd.date_range("2024-01-01", periods=N, freq="h")
    pdf = pd.concat([pd.DataFrame({"series_key": k, "ts": ts, "value": v}) for k, v in (("wave", y), ("walk", walk))])
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df, {"wave": y, "walk": walk}


def _adf(y):
    """Direct least squares on the same definition."""
    d, n = np.diff(y), len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(p, start):
        rows = range(start, len(d))
        x = np.array([[1, y[i], *[d[i - j] for j in range(1, p + 1)]] for i in rows])
        target = d[list(rows)]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = ((target - x @ beta) ** 2).sum()
        return x, beta, rss

    best = min(range(most + 1), key=lambda p: (len(d) - most) * math.log(fit(p, most)[2]) + 2 * (p + 2))
    x, beta, rss = fit(best, best)
    se = math.sqrt(rss / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return best, len(x), beta[1] / se


def test_stationarity_equals_direct_regression(hourly):
    df, values = hourly
    got = {r["series_key"]: r for r in series.stationarity(df).collect()}
    for key, y in values.items():
        lags, n, stat = _adf(y)
        r = got[key]
        assert (r["lags"], r["observations"]) == (lags, n)
        assert r["adf_statistic"] == pytest.approx(stat, abs=2e-3)
        assert r["critical_5pct"] == pytest.approx(-2.866, abs=2e-3)
        assert r["is_stationary"] == (r["p_value"] < 0.05)
    assert not got["walk"]["is_stationary"]


def test_p_values_at_the_critical_values():
    assert series._adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    assert series._adf_p_value(-2.8615) == pytest.approx(0.05, abs=0.001)
    assert series._adf_p_value(5) == 1.0 and series._adf_p_value(-30) == 0.0


def test_decomposition_adds_up(hourly):
    df, _ = hourly
    out = series.decompose(df).withColumn("gap", F.abs(F.col("observed") - F.col("trend") - F.col("seasonal") - F.col("residual")))
    assert out.count() == 2 * N and out.agg(F.max("gap")).first()[0] < 1e-9
    sums = out.groupBy("series_key").agg(F.countDistinct(F.round("seasonal", 8)).alias("k"))
    assert {r["k"] for r in sums.collect()} == {24}


def test_window_ridge_equals_direct_solution(hourly):
    df, values = hourly
    train, test = series.split_last(df, 48)
    got = {r["series_key"]: r for r in series.fit_window_ridge(train).collect()}
    ahead = series.window_forecast(train, test).toPandas()
    for key, y in values.items():
        y = y[:-48]
        v = (y - y.min()) / (y.max() - y.min())
        count = len(v) - 24 - 6 + 1
        x = np.array([v[i : i + 24] for i in range(count)])
        t = v[24 : 24 + count]
        xc, tc = x - x.mean(axis=0), t - t.mean()
        beta = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(24), xc.T @ tc)
        assert np.allclose(got[key]["beta"], beta, atol=1e-9)
        window = list(v[-24:])
        for _ in range(48):
            window.append(np.dot(beta, window[-24:]) + t.mean() - x.mean(axis=0) @ beta)
        want = np.array(window[-48:]) * (y.max() - y.min()) + y.min()
        mine = ahead[ahead["series_key"] == key].sort_values("ts")["forecast"]
        assert len(mine) == 48 and np.allclose(mine, want, atol=1e-6)


def test_seasonal_forecast_follows_the_wave(hourly):
    df, values = hourly
    train, test = series.split_last(df.filter("series_key = 'wave'"), 24)
    out = series.seasonal_forecast(train, test)
    both = series.forecast_against_actual(test, out).toPandas()
    assert len(both) == 24 and both["forecast"].notna().all()
    assert (both["lower"] < both["forecast"]).all() and (both["forecast"] < both["upper"]).all()
    assert series.forecast_metrics(test, out).first()["mae"] < 20
    table = series.forecast_table(train, test, out)
    assert {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()} == {"train": N - 24, "actual": 24, "forecast": 24}


def test_seasonal_forecast_is_exact_on_a_pure_cycle(spark):
    ts = pd.date_range("2024-01-01", periods=240, freq="h")
    y = 10 + 0.1 * np.arange(240) + np.tile(np.arange(24.0), 10)
    df = spark.createDataFrame(pd.DataFrame({"series_key": "a", "ts": ts, "value": y})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    train, test = series.split_last(df, 24)
    out = series.forecast_against_actual(test, series.seasonal_forecast(train, test)).toPandas()
    assert np.allclose(out["forecast"], out["value"], atol=1e-6)


def _simulated(n, p, season, seed):
    """Values of a (1,1,1) x (1,1,1,season) series and its errors."""
    ar, sar, ma, sma = p
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n), np.zeros(n)
    at = lambda x, t: x[t] if t >= 0 else 0.0
    for t in range(n):
        w[t] = ar * at(w, t - 1) + sar * at(w, t - season) - ar * sar * at(w, t - season - 1)
        w[t] += e[t] + ma * at(e, t - 1) + sma * at(e, t - season) + ma * sma * at(e, t - season - 1)
    y = np.zeros(n)
    for t in range(n):
        y[t] = w[t] + at(y, t - 1) + at(y, t - season) - at(y, t - season - 1)
    return y, w


def test_seasonal_coefficients_are_recovered_and_used(spark):
    # Both pairs add up to 0.9: the nearer to 0, the less a series says about its coefficients.
    p, season, n = (0.5, 0.6, 0.4, 0.3), 24, 3000
    y, w = _simulated(n, p, season, 7)
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"series_key": "a", "ts": ts, "value": y})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    train, test = series.split_last(df, 30)
    fit = series.fit_seasonal(train).first()
    got = np.array([fit.ar, fit.seasonal_ar, fit.ma, fit.seasonal_ma])
    assert np.abs(got - p).max() < 0.08 and abs(fit.sigma2 - 1) < 0.1
    held = w[25:-30]
    least = (series._residuals(held, got, 24)[0] ** 2).sum()
    assert least <= (series._residuals(held, np.array(p), 24)[0] ** 2).sum()
    assert all(least <= (series._residuals(held, got + d, 24)[0] ** 2).sum() for d in 0.01 * np.vstack([np.eye(4), -np.eye(4)]))
    # Errors, criteria and forecasts by plain recursion from the coefficients.
    v = y[:-30]
    d = v[25:] - v[24:-1] - v[1:-24] + v[:-25]
    ar, sar, ma, sma = got
    e = np.zeros(len(d))
    for t in range(25, len(d)):
        e[t] = d[t] - ar * d[t - 1] - sar * d[t - 24] + ar * sar * d[t - 25] - ma * e[t - 1] - sma * e[t - 24] - ma * sma * e[t - 25]
    assert np.allclose(e[-25:], fit.errors, atol=1e-8)
    m = len(d) - 25
    assert fit.n == m and fit.sigma2 == pytest.approx((e**2).sum() / m)
    assert fit.aic == pytest.approx(m * (np.log(2 * np.pi * fit.sigma2) + 1) + 10)
    assert fit.bic - fit.aic == pytest.approx(5 * np.log(m) - 10)
    d, e, v = list(d), list(e), list(v)
    for _ in range(30):
        d.append(ar * d[-1] + sar * d[-24] - ar * sar * d[-25] + ma * e[-1] + sma * e[-24] + ma * sma * e[-25])
        e.append(0.0)
        v.append(d[-1] + v[-1] + v[-24] - v[-25])
    out = series.seasonal_forecast(train, test).toPandas().sort_values("ts")
    assert np.allclose(out["forecast"], v[-30:], rtol=1e-6)
    assert ((out["lower"] < y[-30:]) & (y[-30:] < out["upper"])).mean() > 0.6
    report = series.seasonal_report(train, test).first()
    assert report.mae == pytest.approx(np.abs(np.array(v[-30:]) - y[-30:]).mean(), rel=1e-3) and report.aic == pytest.approx(fit.aic)


def test_slopes_of_the_errors(spark):
    _, w = _simulated(200, (0.4, 0.2, -0.3, 0.5), 6, 3)
    p = np.array([0.3, 0.1, -0.2, 0.4])
    _, slopes = series._residuals(w, p, 6)
    for k in range(4):
        h = np.eye(4)[k] * 1e-6
        near = (series._residuals(w, p + h, 6)[0] - series._residuals(w, p - h, 6)[0]) / 2e-6
        assert np.allclose(slopes[:, k], near, atol=1e-5)


def test_short_series_are_left_out(spark, sf):
    train, test, ahead = series.forecast_by_key(readings(spark, sf), "city", steps=24, least=700)
    kept = {r[0] for r in train.select("series_key").distinct().collect()}
    assert kept and {r[0] for r in ahead.select("series_key").distinct().collect()} == kept
    sizes = test.groupBy("series_key").count().toPandas()["count"]
    assert (sizes == 24).all()


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 3)) * [1, 5, 0.2]
    y = x @ [2.0, -1.0, 30.0] + rng.normal(0, 4, 200) + 7
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y))
    preset = models.regressor_presets(n_rows=200, label_std=float(np.std(y)))["ridge"]
    fitted = models.train(df, list("abc"), "y", preset, "ridge").model.stages[-1]
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-6)


def test_auc_equals_pair_count(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 40
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert metrics.roc_auc(df, "y", "s") == pytest.approx(np.mean(pairs), abs=1e-12)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"], row["mcc"]) == (1.0, 0.0, 0.0, 0.0, 0.0)
