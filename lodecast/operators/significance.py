"""Student's t-tests: sums in Spark, the distribution in Arrow batches with one row for each group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function, by the continued fraction of the incomplete beta function (Lentz)."""
    if not (math.isfinite(t) and df > 0):
        return math.nan if math.isnan(t) or not df > 0 else float(t > 0)
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x == 1:
        return 0.5
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = out
        for v in (even, odd):
            d, c = 1 / (1 + v * d or tiny), 1 + v / c or tiny
            out *= c * d
        if abs(out - before) < 1e-16 * abs(out):
            break
    beta = 1 - front * out if swap else front * out
    return 1 - beta / 2 if t > 0 else beta / 2


def t_quantile(p: float, df: float) -> float:
    """The place where the distribution function reaches ``p``, by bisection."""
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_test(rows: DataFrame, keys: list[str], a: str, b: str, which: str = "paired", alternative: str = "greater") -> DataFrame:
    """``keys, t, df, p, low, high``: a paired or Welch test of a against b, missing values left out.

    p is one-sided (``greater``, ``less``) or ``two-sided`` and clipped to
    [0.0001, 0.9999]; low and high bound the mean difference at 95 %. Groups without
    a variance have nulls.
    """
    x, y = (F.when(~F.isnan(c), F.col(c)) for c in (a, b))
    if which == "welch":
        s = rows.groupBy(*keys).agg(F.avg(x).alias("_ma"), F.avg(y).alias("_mb"), F.try_divide(F.var_samp(x), F.count(x)).alias("_va"), F.try_divide(F.var_samp(y), F.count(y)).alias("_vb"), F.count(x).alias("_na"), F.count(y).alias("_nb"))
        df = F.try_divide((F.col("_va") + F.col("_vb")) ** 2, F.col("_va") ** 2 / F.expr("nullif(_na - 1, 0)") + F.col("_vb") ** 2 / F.expr("nullif(_nb - 1, 0)"))
        sums = s.select(*keys, (F.col("_ma") - F.col("_mb")).alias("_d"), F.sqrt(F.col("_va") + F.col("_vb")).alias("_se"), df.alias("df"))
    elif which == "paired":
        s = rows.groupBy(*keys).agg(F.avg(x - y).alias("_d"), F.stddev_samp(x - y).alias("_sd"), F.count(x - y).alias("_n"))
        sums = s.select(*keys, "_d", F.try_divide("_sd", F.sqrt("_n")).alias("_se"), (F.col("_n") - 1).cast("double").alias("df"))
    else:
        raise ValueError(f"no test {which!r}")
    stated = sums.select(*keys, F.try_divide("_d", "_se").alias("t"), "df", "_d", "_se")
    schema = stated.drop("_d", "_se").schema.add("p", "double").add("low", "double").add("high", "double")

    def tested(frames):
        for frame in frames:
            out = []
            for t, df, d, se in frame[["t", "df", "_d", "_se"]].astype(float).itertuples(index=False):
                if math.isnan(t) or not df > 0:
                    out.append((None, None, None))
                    continue
                below = t_cdf(t, df)
                p = {"less": below, "greater": t_cdf(-t, df), "two-sided": 2 * t_cdf(-abs(t), df)}[alternative]
                half = t_quantile(0.975, df) * se
                out.append((min(max(p, 0.0001), 0.9999), d - half, d + half))
            yield pd.concat([frame.drop(columns=["_d", "_se"]), pd.DataFrame(out, columns=["p", "low", "high"], index=frame.index, dtype=float)], axis=1)

    return stated.mapInPandas(tested, schema)
