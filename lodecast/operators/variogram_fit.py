"""Variogram models fitted to each group's experimental curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.operators.shapes import rise

SHAPES = ("exponential", "gaussian", "spherical", "matern")


def fit_curve(x: np.ndarray, y: np.ndarray, kind: str, smoothness: float, nugget: bool, max_range: float, variance: float | None = None) -> tuple[float, float, float, float]:
    """Range, sill (nugget included), nugget and root mean squared error, by damped least squares inside the bounds.

    The structured part is at most ``variance`` and the nugget half of it; without one, the greatest of ``y`` stands for it.
    Given the range, sill and nugget enter linearly; starts at several ranges keep it from local optima.
    """
    top = float(y.max()) if variance is None else float(variance)
    high = np.array([max_range, top, 0.5 * top if nugget else 0.0])
    low = np.array([1e-6 * max_range, 0.0, 0.0])

    def curve(p):
        return p[2] + p[1] * rise(x / p[0], kind, smoothness)

    best = (math.inf, low)
    for start in (0.1, 0.3, 0.6, 0.9):
        p, damp = np.clip([start * max_range, 0.8 * top, 0.1 * top], low, high), 1e-2
        error = float(((curve(p) - y) ** 2).sum())
        for _ in range(200):
            step = 1e-6 * np.maximum(np.abs(p), 1e-6 * np.maximum(high, 1e-12))
            slopes = np.array([(curve(p + step * unit) - curve(p)) / step[i] for i, unit in enumerate(np.eye(3))]).T
            slopes[:, high <= low] = 0
            normal = slopes.T @ slopes
            way = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal)), slopes.T @ (y - curve(p)), rcond=None)[0]
            q = np.clip(p + way, low, high)
            found = float(((curve(q) - y) ** 2).sum())
            if found < error:
                done = error - found < 1e-12 * error
                p, error, damp = q, found, damp / 3
                if done:
                    break
            elif (damp := damp * 4) > 1e12:
                break
        if error < best[0]:
            best = (error, p)
    reach, part, nug = map(float, best[1])
    return reach, part + nug, nug, math.sqrt(best[0] / len(x))


def fit(curves: DataFrame, keys: list[str], width: float, kind: str = "matern", smoothness: float = 1.5, nugget: bool = True, max_range: float = 1000.0, variances: DataFrame | None = None) -> DataFrame:
    """``keys, range, sill, nugget, rmse`` from ``keys, lag, gamma``; a lag stands at its bin's upper edge, (lag + 1) * width.

    ``variances`` (``keys, variance``, see ``value_variances``) bound the sill and the nugget; a group without one has nulls.

    A curve has one row for each lag bin, so a group is small whatever its points.
    Groups with fewer than three lags, or a curve of zeros, have nulls.
    """
    if kind not in SHAPES:
        raise ValueError(f"no variogram model {kind!r}")
    schema, names = curves.select(*keys).schema, ["range", "sill", "nugget", "rmse"]
    for name in names:
        schema = schema.add(name, "double")

    bounded = variances is not None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lag")
        x, y = (frame.lag.to_numpy(float) + 1) * width, frame.gamma.to_numpy(float)
        top = float(frame.variance.iloc[0])
        found = fit_curve(x, y, kind, smoothness, nugget, max_range, top if bounded else None) if len(x) >= 3 and y.max() > 0 and (top > 0 or not bounded) else (math.nan,) * 4
        return frame[keys].head(1).assign(**dict(zip(names, found, strict=True)))

    told = curves.where("gamma IS NOT NULL").select(*keys, "lag", "gamma")
    told = told.withColumn("variance", F.lit(float("nan"))) if variances is None else told.join(variances.select(*keys, "variance"), keys, "left")
    return told.groupBy(*keys).applyInPandas(run, schema)


def value_variances(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, variance``: the population variance of each group's finite values."""
    return rows.where(F.abs(value) < float("inf")).groupBy(*keys).agg(F.var_pop(value).alias("variance"))
