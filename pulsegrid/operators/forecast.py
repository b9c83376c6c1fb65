"""Forecasts of monthly series: naive models in plain expressions, smoothing and autoregression per entity, backtests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEASON, HORIZON, MIN_TRAIN = 12, 6, 12


def naive(series: DataFrame, keys: list[str], horizon: int = HORIZON) -> DataFrame:
    """The last value, again and again."""
    last = series.groupBy(*keys).agg(F.max_by("v", "month").alias("predicted"), F.max("month").alias("last"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "predicted", "last").select(*keys, F.add_months("last", F.col("step")).alias("target"), "step", "predicted")


def seasonal_naive(series: DataFrame, keys: list[str], horizon: int = HORIZON) -> DataFrame:
    """The value of the same month one season before."""
    ranked = series.withColumn("back", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("month"))))
    step = F.lit(SEASON + 1) - F.col("back")
    return ranked.where((F.col("back") <= SEASON) & step.between(1, horizon)).select(*keys, F.add_months("month", SEASON).alias("target"), step.cast("int").alias("step"), F.col("v").alias("predicted"))


def intervals(series: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Plus and minus 1.96 times the larger of the steps' deviation and the count noise, widening with the root of the step."""
    w = W.partitionBy(*keys).orderBy("month")
    s = series.select(*keys, "v", (F.col("v") - F.lag("v").over(w)).alias("step_v"), F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("month"))).alias("back"))
    noise = s.groupBy(*keys).agg(F.stddev_pop("step_v").alias("dev"), F.sqrt(F.greatest(F.avg(F.when(F.col("back") <= 6, F.col("v"))), F.lit(0.0))).alias("count_noise"))
    half = 1.96 * F.greatest("dev", "count_noise") * F.sqrt(F.col("step").cast("double"))
    return forecast.join(noise, keys).select(*keys, "target", "step", "predicted", F.greatest(F.col("predicted") - half, F.lit(0.0)).alias("lower"), (F.col("predicted") + half).alias("upper"))


def naive_backtest(series: DataFrame, keys: list[str], min_train: int = MIN_TRAIN, horizon: int = 3) -> DataFrame:
    """Rolling origins of both naive models in one plan: (origin, target, step, actual, predicted, model)."""
    s = series.select(*keys, "month", "v", F.row_number().over(W.partitionBy(*keys).orderBy("month")).alias("pos"))
    origins = s.where(F.col("pos") >= min_train).select(*keys, F.col("pos").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    at = lambda df, c, name: df.join(s.select(*keys, F.col("pos").alias(c), F.col("v").alias(name)), [*keys, c])
    o = origins.select("*", (F.col("origin") + F.col("step")).alias("target"), (F.col("origin") + F.col("step") - SEASON).alias("before"))
    o = at(at(at(o, "target", "actual"), "origin", "last"), "before", "season")
    return o.select(*keys, "origin", "step", "actual", F.explode(F.array(F.struct(F.lit("naive").alias("model"), F.col("last").alias("predicted")), F.struct(F.lit("seasonal_naive").alias("model"), F.col("season").alias("predicted")))).alias("p")).select(*keys, "origin", "step", "actual", "p.model", "p.predicted")


#: Smoothing parameters that are tried: level, trend, damping, season (none without a season).
GRID = ((0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.2, 0.4), (0.8, 0.9, 0.98), (0.1, 0.3))
#: Orders (autoregressive, differences, moving average) that are tried.
ORDERS = ((1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 1), (1, 0, 0))


def holt_values(values: np.ndarray, horizon: int, season: int = 1) -> tuple[np.ndarray, float]:
    """Damped additive smoothing, seasonal if ``season`` > 1; the parameters with the least one-step error, all of the grid side by side."""
    y = np.asarray(values, float)
    alpha, beta, phi, gamma = (x.ravel() for x in np.meshgrid(*GRID[:3], GRID[3] if season > 1 else (0.0,), indexing="ij"))
    level, trend = np.full(len(alpha), y[:season].mean()), np.zeros(len(alpha))
    s = np.tile(y[:season] - y[:season].mean(), (len(alpha), 1)) if season > 1 else np.zeros((len(alpha), 1))
    error = np.zeros(len(alpha))
    for t, v in enumerate(y):
        k = t % s.shape[1]
        ahead = level + phi * trend
        error += (v - ahead - s[:, k]) ** 2
        new = alpha * (v - s[:, k]) + (1 - alpha) * ahead
        trend = beta * (new - level) + (1 - beta) * phi * trend
        level = new
        if season > 1:
            s[:, k] = gamma * (v - level) + (1 - gamma) * s[:, k]
    best = int(error.argmin())
    damp = np.cumsum(phi[best] ** np.arange(1, horizon + 1))
    later = np.array([s[best, (len(y) + h) % s.shape[1]] for h in range(horizon)])
    return np.maximum(level[best] + damp * trend[best] + later, 0.0), float(error[best])


def _lagged(x: np.ndarray, n: int, lags: int) -> np.ndarray:
    return np.column_stack([x[len(x) - n - k : len(x) - k] for k in range(1, lags + 1)]) if lags else np.empty((n, 0))


def arima(values: np.ndarray, horizon: int) -> np.ndarray:
    """The order with the lowest AIC: shocks from a long autoregression, then least squares on lags of values and shocks."""
    y = np.asarray(values, float)
    best, out = np.inf, np.full(horizon, y[-1])
    for p, d, q in ORDERS:
        x = np.diff(y, d) if d else y
        long = min(6, len(x) // 4)
        if len(x) < 10:
            continue
        if q:
            n = len(x) - long
            z = np.column_stack([np.ones(n), _lagged(x, n, long)])
            shock = np.concatenate([np.zeros(long), x[long:] - z @ np.linalg.lstsq(z, x[long:], rcond=None)[0]])
        else:
            shock = np.zeros(len(x))
        n = len(x) - max(p, q, long if q else 0)
        z = np.column_stack([np.ones(n), _lagged(x, n, p), _lagged(shock, n, q)])
        coef = np.linalg.lstsq(z, x[-n:], rcond=None)[0]
        rest = x[-n:] - z @ coef
        aic = n * np.log(max(float((rest**2).mean()), 1e-9)) + 2 * (1 + p + q)
        if aic < best:
            best, past, shocks, ahead = aic, list(x), list(shock[:-n]) + list(rest), []
            for _ in range(horizon):
                v = coef[0] + sum(c * past[-k - 1] for k, c in enumerate(coef[1 : 1 + p])) + sum(c * shocks[-k - 1] for k, c in enumerate(coef[1 + p :]))
                past.append(v)
                shocks.append(0.0)
                ahead.append(v)
            out = y[-1] + np.cumsum(ahead) if d else np.array(ahead)
    return np.maximum(out, 0.0)


#: Models from the simplest, and the months each needs at least.
MODELS = {
    "naive": (lambda y, h: np.full(h, y[-1]), 1),
    "seasonal_naive": (lambda y, h: np.array([y[len(y) - SEASON + i % SEASON] for i in range(h)]), SEASON),
    "holt": (lambda y, h: holt_values(y, h)[0], 3),
    "holt_winters": (lambda y, h: holt_values(y, h, SEASON)[0], 2 * SEASON),
    "arima": (arima, MIN_TRAIN),
}


def backtested(y: np.ndarray, horizon: int = 3) -> dict[str, tuple[float, int]]:
    """(mean absolute error over all origins and steps, origins that failed) of every model."""
    out = {}
    for name, (model, least) in MODELS.items():
        errors, failed = [], 0
        for origin in range(max(MIN_TRAIN, least), len(y) - horizon + 1):
            try:
                errors.append(np.abs(model(y[:origin], horizon) - y[origin : origin + horizon]).mean())
            except (ValueError, np.linalg.LinAlgError):
                failed += 1
        if errors:
            out[name] = (float(np.mean(errors)), failed)
    return out


def selected(series: DataFrame, key: str, horizon: int = HORIZON, least: int = 15) -> DataFrame:
    """Forecasts of every entity by the model with the lowest backtest error (of equals the simplest); the naive one under ``least`` months.

    ``metric`` is MASE, or MAE where the series is flat; months that are missing from a series are the caller's.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("month")["v"].to_numpy(float)
        scale = float(np.abs(np.diff(y)).mean()) if len(y) > 1 else 0.0
        told = backtested(y) if len(y) >= least else {}
        order = list(MODELS)
        best = min(told, key=lambda m: (round(told[m][0], 9), order.index(m)), default="naive")
        error, failed = told.get(best, (float("nan"), 0))
        ahead = MODELS[best][0](y, horizon)
        metric = error / scale if scale > 0 else error
        return pd.DataFrame([(pdf[key].iloc[0], best, h + 1, float(v), None if np.isnan(metric) else float(metric), failed) for h, v in enumerate(ahead)], columns=[key, "model", "step", "predicted", "metric", "failed"])

    kind = dict(series.dtypes)[key]
    return series.select(key, "month", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, model string, step int, predicted double, metric double, failed int")


def kendall(parts):
    """Rows with a list of (a, b): Kendall's tau-b, by counting inversions while sorting."""
    for part in parts:
        out = []
        for rows in part["x"]:
            a, b = (np.array([r[c] for r in rows], float) for c in ("a", "b"))
            n = len(a)
            ties = lambda *xs: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.column_stack(xs), axis=0, return_counts=True)[1])
            if n < 2:
                out.append(None)
                continue
            order = np.lexsort((b, a))
            swaps, values = _inversions(b[order])
            pairs, same_a, same_b, same = n * (n - 1) // 2, ties(a), ties(b), ties(a, b)
            below = math.sqrt((pairs - same_a) * (pairs - same_b))
            out.append((pairs - same_a - same_b + same - 2 * swaps) / below if below else None)
        yield pd.DataFrame({"kendall": pd.Series(out, dtype="float64")})


def _inversions(x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many pairs are out of order, and the values in order."""
    if len(x) < 2:
        return 0, x
    m = len(x) // 2
    (i, left), (j, right) = _inversions(x[:m]), _inversions(x[m:])
    crossed = int((len(left) - np.searchsorted(left, right, "right")).sum())
    return i + j + crossed, np.sort(np.concatenate([left, right]))


def fitted(series: DataFrame, key: str, horizon: int = HORIZON) -> DataFrame:
    """Holt, Holt-Winters and autoregressive forecasts of every entity; a series is a few dozen months, one group a task's row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        y = pdf["v"].to_numpy()
        models = {"holt": holt_values(y, horizon)[0], "arima": arima(y, horizon)}
        if len(y) >= 2 * SEASON:
            models["holt_winters"] = holt_values(y, horizon, SEASON)[0]
        return pd.DataFrame([(pdf[key].iloc[0], m, h + 1, float(v)) for m, vs in models.items() for h, v in enumerate(vs)], columns=[key, "model", "step", "predicted"])

    kind = dict(series.dtypes)[key]
    return series.select(key, "month", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, model string, step int, predicted double")
