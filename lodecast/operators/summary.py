"""Summaries across models, domains and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.operators.blocks import held
from lodecast.operators.quantiles import exact_percentiles

#: Percent points of a sample summary: two, one and no standard deviations, and the quartiles.
PERCENTS = (2.15, 8.87, 25.0, 50.0, 75.0, 91.13, 97.85)


def percentiles(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, n`` and the seven percentiles of finite values, linearly interpolated."""
    return exact_percentiles(rows, keys, PERCENTS, value)


def rmse(rows: DataFrame, keys: list[str], truth: str = "mu0", value: str = "mu") -> DataFrame:
    """``keys, rmse, corr``; the correlation is null where either side is constant."""
    d = F.col(truth) - F.col(value)
    varied = (F.max(truth) > F.min(truth)) & (F.max(value) > F.min(value))
    corr = F.try_divide(F.covar_pop(truth, value), F.stddev_pop(truth) * F.stddev_pop(value))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.when(varied, corr).alias("corr"))


def mean_and_error(rows: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, n, mean, se`` of finite values: the error is the population deviation over the root of n."""
    rows = rows.withColumn(value, F.when(F.abs(value) < float("inf"), F.col(value)))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("se"))


def weighted_error(rows: DataFrame, keys: list[str], value: str = "v", weight: str = "w") -> DataFrame:
    """``keys, mean, sem``: weighted mean and its standard error for ratio estimates, from one pass of sums.

    The number of observations is the sum of the weights.
    """
    w, x = F.col(weight).cast("double"), F.col(value)
    s = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("wx"), F.sum(w * w * x).alias("w2x"), F.sum(w * w * x * x).alias("w2x2"))
    m, u = F.col("wx") / F.col("w1"), F.col("w1") / F.col("k")
    spread = F.col("w2x2") - 2 * u * m * F.col("wx") + F.col("k") * u * u * m * m
    cross = F.col("w2x") - u * m * F.col("w1") - u * F.col("wx") + F.col("k") * u * u * m
    weights = F.col("w2") - 2 * u * F.col("w1") + F.col("k") * u * u
    n = F.col("w1")
    squared = n / ((n - 1) * F.col("w1") * F.col("w1")) * (spread - 2 * m * cross + m * m * weights)
    return s.select(*keys, m.alias("mean"), F.sqrt(F.greatest(squared, F.lit(0.0))).alias("sem"))


def prefix_moments(sims: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """``keys, m, mean, std``: moments over the first m simulations, for each m of ``sizes``."""
    sized = sims.select(*keys, "sim", "value", F.explode(F.array(*map(F.lit, sizes))).alias("m")).where("sim < m")
    return sized.groupBy(*keys, "m").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def paired_t(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``keys, n, t``: the statistic of a paired t-test; pairs with a missing side are left out."""
    d = F.col(a) - F.col(b)
    return rows.where(d.isNotNull() & ~F.isnan(d)).groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"))


def new_parameters(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` whose keys are not in ``known``, to be appended to it."""
    return found.join(known, keys, "left_anti")


def available(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have an entry in the summary; entries are taken once and, if they are few, go to the rows."""
    return rows.join(held(summary.select(*keys).distinct()), keys, "left_semi")


def attribute_ratios(rows: DataFrame, base: DataFrame, keys: list[str], value: str = "v", low: float | None = None, high: float | None = None) -> DataFrame:
    """``keys, ratio``: each attribute over the same entry of ``base`` plus 1e-6, clamped to the limits given.

    Entries that either side lacks have no row; the matrix is its pivot.
    """
    ratio = F.try_divide(F.col(value), F.col("_base") + 1e-6)
    if low is not None:
        ratio = F.when(F.isnan(ratio), ratio).when(ratio.isNotNull(), F.greatest(ratio, F.lit(low)))
    if high is not None:
        ratio = F.when(F.isnan(ratio), ratio).when(ratio.isNotNull(), F.least(ratio, F.lit(high)))
    other = base.select(*keys, F.col(value).alias("_base")).where("_base IS NOT NULL")
    return rows.where(F.col(value).isNotNull()).join(other, keys).select(*keys, ratio.alias("ratio"))


def matrix(rows: DataFrame, row: str, columns: list[str], names: list[str], value: str = "v") -> DataFrame:
    """One row for each ``row``, one column for each of the ``names`` (its key columns joined by colons); missing entries are null."""
    return rows.select(row, F.concat_ws(":", *columns).alias("_at"), value).groupBy(row).pivot("_at", names).agg(F.first(value))


def kriging_serial(method: str, rotated: bool = True, scored: bool = False, prefix: str = "") -> str:
    """The name of a kriging experiment: [prefix_]method[r]_bt_bi[_nst]."""
    plain = "".join(c for c in method.lower() if c not in "-()")
    return f"{prefix + '_' if prefix else ''}{plain}{'r' if rotated else ''}_bt_bi{'_nst' if scored else ''}"


def slots(rows: DataFrame, counts: DataFrame, model: str, keys: list[str], value: str, weight: str) -> DataFrame:
    """``model, keys, v, w``: each model at every combination of the keys' values in ``counts``, so that those it lacks count with weight 0.

    The weight is the count of the combination where the model has a finite value.
    """
    places = None
    for key in keys:
        own = counts.select(key).distinct()
        places = own if places is None else places.crossJoin(own)  # the values of a key, not rows: some dozens by some dozens
    full = rows.select(model).distinct().crossJoin(places).join(counts.select(*keys, F.col(weight).alias("_w")), keys, "left")
    held = full.join(rows.select(model, *keys, F.col(value).alias("_v")), [model, *keys], "left")
    finite = F.coalesce(F.abs("_v") < float("inf"), F.lit(False)) & F.col("_w").isNotNull()
    return held.select(model, *keys, F.when(finite, F.col("_v")).otherwise(0.0).alias("v"), F.when(finite, F.col("_w")).otherwise(0).cast("double").alias("w"))


def slot_error(placed: DataFrame, keys: list[str], textbook: bool = False) -> DataFrame:
    """``keys, mean, sem``: weighted mean and its standard error over all slots, empty ones included.

    The number of observations is the sum of the weights; with ``textbook``, that of the slots with a weight.
    """
    w, x = F.col("w"), F.col("v")
    s = placed.groupBy(*keys).agg(F.count("*").alias("k"), F.count_if(w > 0).alias("_used"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("wx"), F.sum(w * w * x).alias("w2x"), F.sum(w * w * x * x).alias("w2x2"))
    n = F.col("_used").cast("double") if textbook else F.col("w1")
    m, u, k = F.col("wx") / F.col("w1"), F.col("w1") / F.col("k"), F.col("k")
    spread = F.col("w2x2") - 2 * u * m * F.col("wx") + k * u * u * m * m
    cross = F.col("w2x") - u * m * F.col("w1") - u * F.col("wx") + k * u * u * m
    weights = F.col("w2") - 2 * u * F.col("w1") + k * u * u
    squared = n / ((n - 1) * F.col("w1") * F.col("w1")) * (spread - 2 * m * cross + m * m * weights)
    return s.where("w1 > 0").select(*keys, m.alias("mean"), F.sqrt(F.greatest(squared, F.lit(0.0))).alias("sem"))


def family_means(stats: DataFrame, families: DataFrame, keys: list[str], model: str = "model", value: str = "mean", excluded: list[str] | None = None) -> DataFrame:
    """``family, keys, n, mean, se`` over the models of each family; ``excluded`` models do not count."""
    rows = stats.join(families, model)
    if excluded:
        rows = rows.where(~F.col(model).isin(excluded))
    return mean_and_error(rows.select("family", *keys, F.col(value).alias("v")), ["family", *keys])


def in_order(rows: DataFrame, order: DataFrame, model: str = "model") -> DataFrame:
    """``rows`` with the place of their model in a fixed order; models of the order without a row stay, with nulls."""
    return order.join(rows, model, "left").orderBy("place")


def value_range(rows: DataFrame, keys: list[str], value: str = "mu") -> DataFrame:
    """``keys, low, high`` of finite values, over all models of the keys."""
    v = F.when(F.abs(value) < float("inf"), F.col(value))
    return rows.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def determination(rows: DataFrame, keys: list[str], truth: str = "mu0", value: str = "mu") -> DataFrame:
    """``keys, r2``: one less the residuals' share of the truth's variance, after the mean difference is taken off; null where the truth is constant."""
    d = F.col(truth) - F.col(value)
    return rows.groupBy(*keys).agg((1 - F.try_divide(F.var_pop(d), F.when(F.var_pop(truth) > 0, F.var_pop(truth)))).alias("r2"))


def table_digits(rows: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to some decimal places, halves to the even digit, as printed tables have them."""
    return rows.select(*(F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
