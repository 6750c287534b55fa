"""Regular time series: resampling, decomposition, tests and forecasts, per key.

A prepared series holds one row per key and period, so a key has at most
span / period rows however many readings stand behind them. Readings are
averaged map-side; only these short series are ordered per key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.rounding import half_even
from gridloom.operators.encode import min_max
from gridloom.operators.metrics import regression_metrics
from gridloom.operators.products import keyed_products
from gridloom.operators.quantiles import quantiles
from gridloom.session import materialize

KEY, TS, VALUE = "series_key", "ts", "value"


def period_start(ts: Column, freq: str) -> Column:
    """Label of the hour, day or Monday-to-Sunday week (named by its Sunday)."""
    day = F.to_date(ts)
    if freq == "hour":
        return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))
    if freq == "day":
        return day.cast("timestamp_ntz")
    if freq == "week":
        return F.date_add(day, F.lit(6) - F.weekday(ts)).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


_STEP = {"hour": dict(hours=1), "day": dict(days=1), "week": dict(days=7)}


def _step(freq: str, times: Column | None = None) -> Column:
    unit = F.make_dt_interval(**{k: F.lit(v) for k, v in _STEP[freq].items()})
    return unit if times is None else unit * times


def resample(
    df: DataFrame, target: str, ts: str = "datetime", key: str | None = None, freq: str = "hour", gaps: bool = True,
) -> DataFrame:
    """Mean per period and key; with ``gaps`` empty periods appear with a null."""
    name = F.col(key) if key else F.lit("All")
    means = df.groupBy(name.alias(KEY), period_start(F.col(ts), freq).alias(TS)).agg(F.avg(target).alias(VALUE))
    return on_spine(means, freq) if gaps else means.filter(F.col(VALUE).isNotNull())


def on_spine(means: DataFrame, freq: str) -> DataFrame:
    spine = means.groupBy(KEY).agg(F.min(TS).alias("_a"), F.max(TS).alias("_b")).select(
        KEY, F.explode(F.sequence("_a", "_b", _step(freq))).alias(TS)
    )
    return spine.join(means, [KEY, TS], "left")


def _by_time() -> Window:
    return Window.partitionBy(KEY).orderBy(TS)


def interpolate(series: DataFrame) -> DataFrame:
    """Straight lines over inner gaps by position; a trailing gap keeps the last value."""
    w = _by_time()
    placed = series.withColumn("_i", F.row_number().over(w))
    anchor = F.when(F.col(VALUE).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(VALUE).alias("v")))
    prev = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backwards = Window.partitionBy(KEY).orderBy(F.desc(TS)).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(anchor, ignorenulls=True).over(backwards)
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * F.try_divide((F.col("_i") - p["i"]).cast("double"), (n["i"] - p["i"]).cast("double"))
    return placed.withColumns({"_p": prev, "_n": nxt}).withColumn(VALUE, F.coalesce(VALUE, line, p["v"])).select(KEY, TS, VALUE)


def prepare_series(
    df: DataFrame, target: str = "total_load_mw", ts: str = "datetime", key: str | None = None, freq: str = "hour",
) -> DataFrame:
    return interpolate(resample(df, target, ts, key, freq))


def decompose(series: DataFrame, period: int = 24) -> DataFrame:
    """Trend, seasonal part and residual; they add up to the observed value.

    The trend is the centred mean over one period; half a period at both ends
    is continued on the line through the nearest ``period`` trend values.
    """
    half, w = period // 2, _by_time()
    left, right = w.rowsBetween(-half, half - 1), w.rowsBetween(-(half - 1), half)
    placed = series.withColumns(
        {"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(KEY))}
    )
    inner = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
    mean = (F.sum(VALUE).over(left) + F.sum(VALUE).over(right)) / F.lit(2.0 * period)
    placed = placed.withColumn("_t", F.when(inner, mean))
    head = inner & (F.col("_i") < half + period)
    tail = inner & (F.col("_i") >= F.col("_n") - half - period)
    x = F.col("_i").cast("double")
    lines = placed.groupBy(KEY).agg(
        *[
            fn(F.when(where, F.col("_t")), F.when(where, x)).alias(f"_{side}_{part}")
            for side, where in (("head", head), ("tail", tail))
            for part, fn in (("k", F.regr_slope), ("c", F.regr_intercept))
        ]
    )
    ends = F.when(F.col("_i") < half, F.col("_head_c") + F.col("_head_k") * x).otherwise(F.col("_tail_c") + F.col("_tail_k") * x)
    trended = placed.join(lines, KEY).withColumn("trend", F.coalesce("_t", ends)).withColumn("_phase", F.col("_i") % period)
    phases = trended.groupBy(KEY, "_phase").agg(F.avg(F.col(VALUE) - F.col("trend")).alias("_s"))
    phases = phases.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy(KEY))).drop("_s")
    return trended.join(phases, [KEY, "_phase"]).select(
        KEY, TS, F.col(VALUE).alias("observed"), "trend", "seasonal",
        (F.col(VALUE) - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def load_peaks(series: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Points above the quantile of their own series."""
    cuts = quantiles(series, [VALUE], [quantile], (KEY,)).select(KEY, F.col("quantiles")[0].alias("threshold"))
    return series.join(cuts, KEY).filter(F.col(VALUE) > F.col("threshold"))


def trend_statistics(series: DataFrame, period: int = 24) -> DataFrame:
    """Mean, deviation, extremes and slope per day of the trend."""
    t = F.col("trend")
    found = decompose(series, period).filter(t.isNotNull()).groupBy(KEY).agg(
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"),
        ((F.max_by(t, TS) - F.min_by(t, TS)) / (F.count(t) / 24)).alias("slope_mw_day"),
    )
    return found.select(
        KEY, *[half_even(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "max")],
        half_even(F.col("slope_mw_day"), 4).alias("slope_mw_day"),
    )


def smooth(series: DataFrame, window: int = 7) -> DataFrame:
    """Moving mean over full windows, next to the original values."""
    frame = _by_time().rowsBetween(-(window - 1), 0)
    rolled = F.when(F.count(VALUE).over(frame) == window, F.avg(VALUE).over(frame))
    return series.withColumn("rolled", rolled)


def split_last(series: DataFrame, points: int | Column) -> tuple[DataFrame, DataFrame]:
    """History and the last ``points`` rows of every series."""
    points = F.lit(points) if isinstance(points, int) else points
    placed = series.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TS))))
    held = F.col("_r") <= points
    return placed.filter(~held).drop("_r"), placed.filter(held).drop("_r")


def last_points(series: DataFrame, points: int) -> DataFrame:
    return split_last(series, points)[1]


# --- keyed regression: sums of products in Spark, one small solve per key ----


def gram(rows: DataFrame, vector: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sums of products of all pairs of vector entries, per key: (key, keep..., i, j, s, n)."""
    return keyed_products(rows, vector, [KEY, *keep])


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    k = int(pdf["j"].max()) + 1
    m = np.zeros((k, k))
    m[pdf["i"], pdf["j"]] = pdf["s"]
    m[pdf["j"], pdf["i"]] = pdf["s"]
    return m


def _least_squares(m: np.ndarray, inputs: list[int], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse and residual sum of squares; the target is the last entry."""
    a, b = m[np.ix_(inputs, inputs)], m[inputs, -1]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    return beta, inverse, max(float(m[-1, -1] - beta @ b), 1e-300)


# Response surface of the unit-root test with constant, one series.
_ADF_CRITICAL = {
    "critical_1pct": (-3.43035, -6.5393, -16.786, -79.433),
    "critical_5pct": (-2.86154, -2.8903, -4.234, -40.040),
    "critical_10pct": (-2.56677, -1.5384, -2.809, 0.0),
}
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_SPLIT, _ADF_LOWEST, _ADF_HIGHEST = -1.61, -18.83, 2.74


def _adf_p_value(stat: float) -> float:
    if stat > _ADF_HIGHEST:
        return 1.0
    if stat < _ADF_LOWEST:
        return 0.0
    terms = _ADF_SMALL if stat <= _ADF_SPLIT else _ADF_LARGE
    z = sum(c * stat**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _adf_rows(series: DataFrame, lags: Column, most: int) -> DataFrame:
    """Regression rows [1, level, earlier differences..., difference] with all ``lags`` (at most ``most``) present."""
    w = _by_time()
    step = F.col(VALUE) - F.lag(VALUE).over(w)
    placed = series.filter(F.col(VALUE).isNotNull()).withColumns(
        {"_d": step, "_level": F.lag(VALUE).over(w), "_i": F.row_number().over(w), "_p": lags}
    )
    if most:
        history = F.collect_list("_d").over(w.rowsBetween(-most, -1))
        count = F.greatest(F.col("_p"), F.lit(1))
        recent = F.when(F.col("_p") > 0, F.reverse(F.slice(history, -count, count)))
    else:
        recent = F.lit(None).cast("array<double>")
    ready = placed.withColumn("_past", F.coalesce(recent, F.array().cast("array<double>"))).filter(
        (F.col("_i") >= F.col("_p") + 2) & (F.size("_past") == F.col("_p"))
    )
    return ready.withColumn("x", F.concat(F.array(F.lit(1.0), F.col("_level")), F.col("_past"), F.array(F.col("_d"))))


def stationarity(series: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test per key, lag length by AIC."""
    sized = series.filter(F.col(VALUE).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    schwert = F.ceil(F.lit(12.0) * F.pow(F.col("_n") / 100.0, F.lit(0.25)))
    most = F.greatest(F.least(schwert, F.floor(F.col("_n") / 2) - 2), F.lit(0)).cast("int")
    top = sized.agg(F.max(most)).first()[0] or 0
    common = gram(_adf_rows(sized, most, top))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = _matrix(pdf), int(pdf["n"].iloc[0])
        best, lags = math.inf, 0
        for p in range(len(m) - 2):
            inputs = list(range(p + 2))
            rss = _least_squares(m, inputs, n)[2]
            aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * len(inputs)
            if aic < best:
                best, lags = aic, p
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "lags": [lags]})

    chosen = common.groupBy(KEY).applyInPandas(choose, f"{KEY} string, lags int")
    final = gram(_adf_rows(sized.join(chosen, KEY), F.col("lags"), top), keep=("lags",))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = _matrix(pdf), int(pdf["n"].iloc[0])
        inputs = list(range(len(m) - 1))
        beta, inverse, rss = _least_squares(m, inputs, n)
        stat = float(beta[1] / math.sqrt(rss / (n - len(inputs)) * inverse[1, 1]))
        p = _adf_p_value(stat)
        out = {KEY: pdf[KEY].iloc[0], "adf_statistic": round(stat, 4), "p_value": round(p, 6),
               "lags": int(pdf["lags"].iloc[0]), "observations": n}
        for name in ("critical_1pct", "critical_5pct"):
            out[name] = round(sum(c / n**i for i, c in enumerate(_ADF_CRITICAL[name])), 4)
        return pd.DataFrame([out | {"is_stationary": p < 0.05}])

    return final.groupBy(KEY).applyInPandas(
        test,
        f"{KEY} string, adf_statistic double, p_value double, lags int, observations long, "
        "critical_1pct double, critical_5pct double, is_stationary boolean",
    )


def _horizon_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Last time of the history and number of steps to forecast, per key."""
    return train.groupBy(KEY).agg(F.max(TS).alias("_end")).join(
        test.groupBy(KEY).agg(F.count("*").alias("_steps")), KEY
    )


def _unknown(row: pd.Series, *columns: str) -> pd.DataFrame:
    """The steps of a key that cannot be forecast."""
    steps = int(row["_steps"])
    nothing = {c: np.full(steps, None, dtype=object) for c in columns}
    return pd.DataFrame({KEY: row[KEY], "_end": row["_end"], "step": np.arange(1, steps + 1), **nothing}).astype({c: "Float64" for c in columns})


def _tail(train: DataFrame, points: int) -> DataFrame:
    """The last ``points`` values of each series, in order, as one array."""
    return (
        last_points(train, points)
        .groupBy(KEY)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(TS, VALUE))), lambda s: s[VALUE]).alias("tail"))
    )


def _dated(forecast: DataFrame, freq: str) -> DataFrame:
    """Put time labels on forecast steps 1, 2, ..."""
    return forecast.withColumn(TS, F.col("_end") + _step(freq, F.col("step"))).drop("_end", "step")


def _unmoved(x: np.ndarray, a: float, step: int) -> np.ndarray:
    """e with e[t] + a e[t - step] = x[t], nothing before the first: the inverse as a product of log2(n) shifts."""
    out, c, k = x.copy(), -a, step
    while k < len(out):
        out[k:] = out[k:] + c * out[:-k]
        c, k = c * c, 2 * k
    return out


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(min(k, len(x))), x[: max(len(x) - k, 0)]])


def _residuals(w: np.ndarray, p: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of the doubly differenced values and their derivatives by the four coefficients.

    (1 - p0 B)(1 - p1 B^season) w = (1 + p2 B)(1 + p3 B^season) e, from the
    first value that has all its lags; errors before it count as 0.
    """
    ar, sar, ma, sma = p
    late = lambda k: w[season + 1 - k: len(w) - k]
    filtered = lambda x: _unmoved(_unmoved(x, sma, season), ma, 1)
    e = filtered(late(0) - ar * late(1) - sar * late(season) + ar * sar * late(season + 1))
    far = _shifted(e, season + 1)
    slopes = (late(1) - sar * late(season + 1), late(season) - ar * late(season + 1), _shifted(e, 1) + sma * far, _shifted(e, season) + ma * far)
    return e, np.stack([-filtered(x) for x in slopes], axis=1)


def _first_guess(w: np.ndarray, season: int) -> np.ndarray | None:
    """Two regressions: a long autoregression for the errors, then lags of values and errors."""
    lags = [*range(1, 5), season, season + 1, season + 2, 2 * season]
    top = max(lags)
    if len(w) < 2 * top + 2 * len(lags):
        return None
    past = np.stack([w[top - k: len(w) - k] for k in lags], axis=1)
    e = w[top:] - past @ np.linalg.lstsq(past, w[top:], rcond=None)[0]
    v, back = w[top:], season
    inputs = np.stack([v[back - 1: len(v) - 1], v[: len(v) - back], e[back - 1: len(e) - 1], e[: len(e) - back]], axis=1)
    return np.clip(np.linalg.lstsq(inputs, v[back:], rcond=None)[0], -0.9, 0.9)


def _least_errors(w: np.ndarray, season: int, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients with the least sum of squared errors, by Gauss-Newton steps from two starts, and that sum."""
    best = (np.zeros(4), math.inf)
    for start in (np.zeros(4), _first_guess(w, season)):
        if start is None:
            continue
        p = start
        e, slopes = _residuals(w, p, season)
        total = float(e @ e)
        for _ in range(rounds):
            step = np.linalg.lstsq(slopes, -e, rcond=None)[0]
            rate = 1.0
            while rate > 1e-4:
                q = p + rate * step
                if np.abs(q).max() < 0.999:
                    f, turned = _residuals(w, q, season)
                    if f @ f < total:
                        break
                rate /= 2
            else:
                break
            gained, p, e, slopes, total = total - float(f @ f), q, f, turned, float(f @ f)
            if gained <= 1e-10 * total:
                break
        if total < best[1]:
            best = (p, total)
    return best


_FIT = "ar double, seasonal_ar double, ma double, seasonal_ma double, sigma2 double, n long, aic double, bic double"


def fit_seasonal(train: DataFrame, season: int = 24) -> DataFrame:
    """(1,1,1) x (1,1,1,season) per key by the conditional sum of squares: coefficients, error variance, AIC, BIC, last errors.

    A key's history is one row per period, so it is fitted in one group. Keys
    too short for four errors more than the lags are left out; a series that its
    differences explain in full has coefficients 0 and no AIC.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(TS)[VALUE].to_numpy(dtype=float)
        w = y[season + 1:] - y[season:-1] - y[1: -season] + y[: -season - 1] if len(y) > season + 1 else np.empty(0)
        n = len(w) - season - 1
        names = [c.split()[0] for c in _FIT.split(", ")]
        if n < 4 or len(y) < 2 * (season + 1) or np.isnan(w).any():
            return pd.DataFrame(columns=[KEY, *names, "errors"])
        scale = float(np.abs(y).max()) or 1.0
        p, total = (np.zeros(4), 0.0) if np.abs(w).max() <= 1e-9 * scale else _least_errors(w, season)
        variance = total / n
        fit_ = n * (math.log(2 * math.pi * variance) + 1) if variance else None
        criteria = (fit_ + 2 * 5, fit_ + math.log(n) * 5) if fit_ is not None else (None, None)
        errors = _residuals(w, p, season)[0][-(season + 1):].tolist() if total else []
        row = dict(zip(names, [*p.tolist(), variance, n, *criteria]))
        return pd.DataFrame([{KEY: pdf[KEY].iloc[0], **row, "errors": errors}])

    return train.groupBy(KEY).applyInPandas(fit, f"{KEY} string, {_FIT}, errors array<double>")


def seasonal_forecast(train: DataFrame, test: DataFrame, season: int = 24, freq: str = "hour", fitted: DataFrame | None = None) -> DataFrame:
    """Forecast of (1,1,1) x (1,1,1,season) for the rows of ``test``, with a band of 1.96 deviations from the impulse weights.

    ``fitted`` takes stored coefficients of ``fit_seasonal``. Forecasts run
    recursively on values and errors, future errors being 0. A key whose history is too
    short to fit gets its steps with null values.
    """
    fitted = fit_seasonal(train, season) if fitted is None else fitted
    state = _horizon_rows(train, test).join(fitted, KEY, "left").join(_tail(train, 2 * (season + 1)), KEY, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        if row["errors"] is None or len(row["tail"]) < 2 * (season + 1):
            return _unknown(row, "forecast", "lower", "upper")
        steps = int(row["_steps"])

        def factor(one: float, seasonal: float) -> np.ndarray:
            out = np.zeros(season + 2)
            out[0], out[1], out[season], out[season + 1] = 1.0, one, seasonal, one * seasonal
            return out

        # One recursion on y: the autoregression times both differences.
        weights = -np.convolve(factor(-row["ar"], -row["seasonal_ar"]), factor(-1.0, -1.0))[1:]
        moving = factor(row["ma"], row["seasonal_ma"])
        values = list(np.asarray(row["tail"], float))
        errors = [0.0] * (season + 1) + list(np.asarray(row["errors"], float))
        psi = [1.0]
        for h in range(1, steps + 1):
            shock = sum(moving[k] * errors[len(errors) + h - 1 - k] for k in range(h, season + 2))
            values.append(float(np.dot(weights, values[-1 : -len(weights) - 1 : -1])) + shock)
            psi.append(float(np.dot(weights[: len(psi)], psi[::-1][: len(weights)])) + (moving[h] if h < season + 2 else 0.0))
        sigma = math.sqrt(row["sigma2"] * row["n"] / max(row["n"] - 4, 1))
        band = 1.96 * sigma * np.sqrt(np.cumsum(np.square(psi[:steps])))
        out = np.array(values[-steps:])
        return pd.DataFrame({KEY: row[KEY], "_end": row["_end"], "step": np.arange(1, steps + 1),
                             "forecast": out, "lower": out - band, "upper": out + band})

    done = state.groupBy(KEY).applyInPandas(
        run, f"{KEY} string, _end timestamp_ntz, step int, forecast double, lower double, upper double"
    )
    return _dated(done, freq)


def seasonal_report(train: DataFrame, test: DataFrame, season: int = 24, freq: str = "hour") -> DataFrame:
    """Coefficients, variance, AIC and BIC per key with MAE, RMSE and MAPE on the held-out rows."""
    fitted = materialize(fit_seasonal(train, season), "seasonal-fit")
    metrics = forecast_metrics(test, seasonal_forecast(train, test, season, freq, fitted))
    return fitted.drop("errors").join(metrics, KEY)


def fit_window_ridge(train: DataFrame, lags: int = 24, horizon: int = 6, alpha: float = 0.5) -> DataFrame:
    """Ridge coefficients per key on the lag windows of the 0..1 scaled series.

    The last ``horizon - 1`` targets are left out; the intercept is not
    penalised. Columns: key, beta, intercept, lo, hi.
    """
    w = _by_time()
    scaled = min_max(train, VALUE, "_v", (KEY,))
    windows = scaled.withColumns(
        {
            "_lags": F.collect_list("_v").over(w.rowsBetween(-lags, -1)),
            "_left": F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TS))) - 1,
        }
    ).filter((F.size("_lags") == lags) & (F.col("_left") >= horizon - 1))
    rows = windows.withColumn("x", F.concat(F.array(F.lit(1.0)), F.col("_lags"), F.array(F.col("_v"))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = _matrix(pdf), int(pdf["n"].iloc[0])
        means = m[0, 1:] / n
        centred = m[1:, 1:] - n * np.outer(means, means)
        beta = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(lags), centred[:-1, -1])
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "beta": [beta], "intercept": [float(means[-1] - beta @ means[:-1])]})

    fitted = gram(rows).groupBy(KEY).applyInPandas(solve, f"{KEY} string, beta array<double>, intercept double")
    return fitted.join(train.groupBy(KEY).agg(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")), KEY)


def window_forecast(
    train: DataFrame, test: DataFrame, lags: int = 24, horizon: int = 6, alpha: float = 0.5, freq: str = "hour",
) -> DataFrame:
    """Recursive forecast of the window ridge for the rows of ``test``; null values for a key that is too short to fit."""
    fitted = fit_window_ridge(train, lags, horizon, alpha)
    state = _horizon_rows(train, test).join(fitted, KEY, "left").join(_tail(train, lags), KEY, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        if row["beta"] is None or len(row["tail"]) < lags:
            return _unknown(row, "forecast")
        lo, span, steps = row["lo"], (row["hi"] - row["lo"]) or 1.0, int(row["_steps"])
        beta = np.asarray(row["beta"], float)
        values = list((np.asarray(row["tail"], float) - lo) / span)
        for _ in range(steps):
            values.append(float(beta @ np.array(values[-lags:]) + row["intercept"]))
        return pd.DataFrame({KEY: row[KEY], "_end": row["_end"], "step": np.arange(1, steps + 1),
                             "forecast": np.array(values[-steps:]) * span + lo})

    done = state.groupBy(KEY).applyInPandas(run, f"{KEY} string, _end timestamp_ntz, step int, forecast double")
    return _dated(done, freq)


def forecast_table(train: DataFrame, test: DataFrame, forecast: DataFrame) -> DataFrame:
    """Long table of history, held-out values and forecasts, tagged by kind."""
    extra = [c for c in ("lower", "upper") if c in forecast.columns]
    none = [F.lit(None).cast("double").alias(c) for c in extra]
    history = train.select(KEY, TS, F.lit("train").alias("kind"), VALUE, *none)
    actual = test.select(KEY, TS, F.lit("actual").alias("kind"), VALUE, *none)
    ahead = forecast.select(KEY, TS, F.lit("forecast").alias("kind"), F.col("forecast").alias(VALUE), *extra)
    return history.unionByName(actual).unionByName(ahead)


def forecast_against_actual(test: DataFrame, forecast: DataFrame) -> DataFrame:
    return test.join(forecast, [KEY, TS], "left")


def forecast_metrics(test: DataFrame, forecast: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE per key."""
    both = test.join(forecast, [KEY, TS])
    return regression_metrics(both, VALUE, "forecast", (KEY,)).select(KEY, "mae", "rmse", "mape")


def forecast_by_key(
    df: DataFrame, key: str, target: str = "total_load_mw", ts: str = "datetime", steps: int = 24, least: int = 100,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecast every key with enough points in one job: (train, test, forecast).

    The horizon is ``steps`` or a quarter of the series, whichever is less.
    """
    series = prepare_series(df, target, ts, key).withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    series = materialize(series.filter(F.col("_n") >= least), "series")  # span / period rows per key, read several times
    train, test = split_last(series, F.least(F.lit(steps), F.floor(F.col("_n") / 4)))
    train, test = train.drop("_n"), test.drop("_n")
    return train, test, seasonal_forecast(train, test)
