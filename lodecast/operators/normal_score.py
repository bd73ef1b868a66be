"""Normal score transform of each group's values, its inverse and its variance correction."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.functions.normal import normal_cdf, normal_quantile
from lodecast.operators.blocks import cut, held, in_blocks
from lodecast.operators.ordered import in_order, running
from lodecast.operators.quantiles import even_quantiles, exact_percentiles, ranked

#: Quantiles of a group with more rows than that; smaller groups keep all their values.
QUANTILES = 1000
#: Rows that one task transforms together.
BLOCK_ROWS = 65536
# Fixed value: scores keep this distance from the probabilities 0 and 1.
EDGE = 1e-7


def quantiles(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, quantiles``: evenly spaced quantiles of each group's values, null and NaN left out."""
    return even_quantiles(rows, keys, QUANTILES, value)


def _score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    at = np.linspace(0, 1, len(q)) if len(q) > 1 else np.array([0.5])
    p = 0.5 * (np.interp(x, q, at) - np.interp(-x, -q[::-1], -at[::-1]))  # ties get the middle of their probabilities
    normal = NormalDist()
    return np.array([math.nan if math.isnan(v) else normal.inv_cdf(v) for v in np.clip(p, EDGE, 1 - EDGE)])


def _unscore(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    normal = NormalDist()
    p = np.array([math.nan if math.isnan(v) else normal.cdf(v) for v in x])
    p = np.where(p <= EDGE * (1 + 1e-6), 0, np.where(p >= 1 - EDGE * (1 + 1e-6), 1, p))
    return np.interp(p, np.linspace(0, 1, len(q)) if len(q) > 1 else np.array([0.5]), q)


#: Ranks that meet the values of these ranks together.
SPAN = 64


def ranks(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Each distinct value of a group with all its ranks, as ``ranked`` has them, written once: what exact scores and their inverse need."""
    return cut(ranked(rows, keys, value), "ranks")


def exact_transform(rows: DataFrame, told: DataFrame, keys: list[str], value: str = "v", into: str = "score") -> DataFrame:
    """``rows`` with their normal scores by ``ranks``, however large a group is; missing values have none."""
    middle = F.when(F.col("n") > 1, (F.col("_first") + F.col("_last") - 1) / 2 / (F.col("n") - 1)).otherwise(0.5)
    probable = told.select(*keys, F.col("_x").alias(value), F.least(F.greatest(middle, F.lit(EDGE)), F.lit(1 - EDGE)).alias("_p"))
    return rows.drop(into).join(probable, [*keys, value], "left").select(*rows.drop(into).columns, F.expr(normal_quantile("_p")).alias(into))


def exact_inverse(rows: DataFrame, told: DataFrame, keys: list[str], value: str = "score", into: str = "v") -> DataFrame:
    """``rows`` with the values that belong to their scores, interpolated between the two order statistics around them.

    Only ranks that a row asks for are looked up, each once, among the values that share a span of ranks with it.
    """
    sizes = held(told.groupBy(*keys).agg(F.max("n").alias("_n")))
    p = F.expr(normal_cdf(value))
    p = F.when(p <= EDGE * (1 + 1e-6), 0.0).when(p >= 1 - EDGE * (1 + 1e-6), 1.0).otherwise(p)
    at = rows.drop(into).join(sizes, keys, "left").withColumn("_at", p * (F.col("_n") - 1))
    at = at.withColumn("_low", F.floor("_at")).withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1))
    wanted = at.select(*keys, F.explode(F.array("_low", "_high")).alias("_rank")).where("_rank IS NOT NULL").distinct()
    spans = told.select(*keys, "_x", "_first", "_last", F.explode(F.expr(f"sequence(_first div {SPAN}, (_last - 1) div {SPAN})")).alias("_span"))
    found = wanted.withColumn("_span", F.expr(f"_rank div {SPAN}")).join(spans, [*keys, "_span"]).where("_first <= _rank AND _rank < _last")
    for side in ("_low", "_high"):
        at = at.join(found.select(*keys, F.col("_rank").alias(side), F.col("_x").alias(f"_x{side}")), [*keys, side], "left")
    return at.select(*rows.drop(into).columns, (F.col("_x_low") + (F.col("_x_high") - F.col("_x_low")) * (F.col("_at") - F.col("_low"))).alias(into))


def _mapped(rows: DataFrame, fitted: DataFrame, keys: list[str], value: str, into: str, change) -> DataFrame:
    parted, side = in_blocks(rows.drop(into), fitted, keys, BLOCK_ROWS)
    schema = rows.drop(into).select("*", F.lit(None).cast("double").alias(into)).schema
    names = schema.names

    def apply(frame: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or q.empty:
            return pd.DataFrame({n: [] for n in names})
        return frame.assign(**{into: change(frame[value].to_numpy(float), np.asarray(q["quantiles"].iloc[0], float))})[names]

    return parted.groupBy(*keys, "_b").cogroup(side.groupBy(*keys, "_b")).applyInPandas(apply, schema)


def transform(rows: DataFrame, fitted: DataFrame, keys: list[str], value: str = "v", into: str = "score") -> DataFrame:
    """``rows`` with their normal scores; rows of a group without quantiles are left out, missing values stay missing."""
    return _mapped(rows, fitted, keys, value, into, _score)


def inverse(rows: DataFrame, fitted: DataFrame, keys: list[str], value: str = "score", into: str = "v") -> DataFrame:
    """``rows`` with the values that belong to their scores."""
    return _mapped(rows, fitted, keys, value, into, _unscore)


def gradient(rows: DataFrame, keys: list[str], value: str = "v", score: str = "score") -> DataFrame:
    """``keys, gradient``: the median positive slope of score over value, by which deviations of scores are divided.

    Equal rows have no slope between them and are taken once; null and NaN have none. Order and median go over all tasks.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & ~F.isnan(score)).select(*keys, F.col(value).alias("_v"), F.col(score).alias("_s")).distinct()
    told = running(in_order(known, [*keys, "_v", "_s"]), keys, ["_v", "_s"], previous=("_v", "_s"))
    slope = (F.col("_s") - F.col("_s_previous")) / (1e-9 + F.col("_v") - F.col("_v_previous"))
    return exact_percentiles(told.select(*keys, slope.alias("_g")).where("_g > 0"), keys, (50.0,), "_g").select(*keys, F.col("p0").alias("gradient"))
