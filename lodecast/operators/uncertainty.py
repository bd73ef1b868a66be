"""Uncertainty measures of predicted distributions: consensus, accuracy, precision, goodness, tails."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.functions.normal import synchronicity
from lodecast.operators.quantiles import exact_percentiles


def probability_grid() -> list[float]:
    """256 proportions: 245 inside (0, 0.98) evenly, and 11 from 0.98 to below 1."""
    return [0.98 * i / 246 for i in range(1, 246)] + [0.98 + 0.02 * i / 11 for i in range(11)]


def with_synchronicity(rows: DataFrame) -> DataFrame:
    """``rows`` of finite truth, mean and deviation, with ``s`` and ``p_star`` = 1 - abs(s)."""
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("mu0", "mu", "sigma"))
    return rows.where(finite).withColumn("s", F.expr(synchronicity())).withColumn("p_star", 1 - F.abs("s"))


def _place(needed: Column) -> Column:
    """The first place (from 1) of the grid that is not below ``needed``, or 257 beyond the grid.

    Both parts of the grid are even, so the place follows by division; a step to
    either side then settles it by the grid's own values.
    """
    def value(i: Column) -> Column:
        return F.when(i <= 245, F.lit(0.98) * i / 246).otherwise(F.lit(0.98) + F.lit(0.02) * (i - 246) / 11)

    near = F.when(needed <= 0.98, F.ceil(needed * 246 / 0.98)).otherwise(246 + F.ceil((needed - 0.98) * 11 / 0.02))
    at = F.greatest(F.least(near.cast("int"), F.lit(257)), F.lit(1))
    return F.when((at > 1) & (value(at - 1) >= needed), at - 1).when((at <= 256) & (value(at) < needed), at + 1).otherwise(at)


def _width() -> Column:
    """The width of a row's interval: twice its deviation times abs(z), five at most.

    The quantile of (1 + p_star) / 2 is abs(z) by the definition of s.
    """
    return 2 * F.least(F.abs(F.col("mu0") - F.col("mu")) / (F.col("sigma") + 1e-6), F.lit(5.0)) * F.col("sigma")


def _places(scored: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """Rows by the grid places that count them first, without and with slack: all that the measures need, from one scan.

    At most 257 places by a few with slack for each group, however many rows.
    """
    at = [_place(F.col("p_star") * (1 - v)).alias(n) for v, n in ((0.0, "_at"), (slack, "_loose"))]
    return scored.groupBy(*keys, *at).agg(F.count("*").alias("_n"), F.sum(F.abs("s")).alias("_s"), F.sum(_width()).alias("_w"))


def _on_grid(places: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys, _at, p, _n, _w``: rows and widths counted up to each grid proportion, with the group's total ``_all``."""
    sums = places.groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(F.sum("_n").alias("_c"), F.sum("_w").alias("_d"))
    by_place = F.map_from_entries(F.collect_list(F.struct(F.col("_at"), F.struct("_c", "_d"))))
    grouped = sums.groupBy(*keys).agg(by_place.alias("_by"), F.sum("_c").alias("_all"))
    full = grouped.select(*keys, "_by", "_all", F.posexplode(F.array(*map(F.lit, probability_grid()))).alias("_i", "p")).withColumn("_at", (F.col("_i") + 1).cast("long"))
    own = F.col("_by")[F.col("_at")]
    running = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = full.select(*keys, "_at", "p", "_all", F.coalesce(own["_c"], F.lit(0)).alias("_c"), F.coalesce(own["_d"], F.lit(0.0)).alias("_d"))
    return counted.select(*keys, "_at", "p", "_all", F.sum("_c").over(running).alias("_n"), F.sum("_d").over(running).alias("_w"))


def kappa(scored: DataFrame, keys: list[str], slack: float = 0.0) -> DataFrame:
    """``keys, p, kappa``: for each grid proportion p, the share of rows with p >= (1 - slack) p_star.

    Each row falls into the first grid place that counts it; a running sum over at
    most 257 places gives all shares, so rows are never multiplied by the grid.
    """
    return _on_grid(_places(scored, keys, slack), keys, "_loose").select(*keys, "_at", "p", (F.col("_n") / F.col("_all")).alias("kappa"))


def coverage_measures(scored: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """``keys, consensus, proportion, accuracy, precision, goodness`` of scored rows."""
    return performance(scored, keys, slack).drop("tightness", "n")


def performance(scored: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """``keys, n, consensus, proportion, accuracy, precision, goodness, tightness`` of scored rows, from one scan.

    Accuracy and proportion allow for the slack. Tightness is the mean interval
    width over p, in deviations of the truth (of 1 where it is constant).
    """
    places = _places(scored, keys, slack)
    step = F.col("p") - F.lag("p", 1, 0.0).over(Window.partitionBy(*keys).orderBy("_at"))
    strict = _on_grid(places, keys, "_at").withColumns({"_dp": step, "kappa": F.col("_n") / F.col("_all")})
    share = F.col("_dp") / F.sum("_dp").over(Window.partitionBy(*keys))
    over = (F.col("kappa") >= F.col("p")).cast("int")
    gap = F.col("kappa") - F.col("p")
    wide = F.col("_n") > 0
    measured = strict.withColumn("_wt", share).groupBy(*keys).agg(
        F.avg((F.col("kappa") >= (1 - slack) * F.col("p")).cast("double")).alias("accuracy"),
        (1 - 2 * F.sum(over * gap * F.col("_wt"))).alias("precision"),
        (1 - F.sum((3 * over - 2) * gap * F.col("_wt"))).alias("goodness"),
        (F.sum(F.when(wide, F.col("_w") / F.col("_n") * F.col("_dp"))) / F.sum(F.when(wide, F.col("_dp")))).alias("_width"),
    )
    loose = _on_grid(places, keys, "_loose").groupBy(*keys).agg(F.avg(F.col("_n") / F.col("_all")).alias("proportion"))
    # The spread of the truth is taken around its mean, as sums of squares lose digits.
    spread = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs("s")).alias("consensus"), F.stddev_pop("mu0").alias("_sd"))
    tight = F.col("_width") / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return spread.join(loose, keys).join(measured, keys).select(*keys, "n", "consensus", "proportion", "accuracy", "precision", "goodness", tight.alias("tightness"))


def tail_shares(scored: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """``keys`` with, under each name, the share of rows whose abs(s) is at most the limit."""
    def share(limit: float) -> Column:
        return F.avg((F.abs("s") <= limit).cast("double"))

    return scored.groupBy(*keys).agg(*(share(v).alias(k) for k, v in limits.items()))


def accuracy_by_slack(scored: DataFrame, keys: list[str], slacks: list[float]) -> DataFrame:
    """``keys, slack, accuracy``: the share of proportions p whose kappa reaches (1 - slack) p."""
    every = F.explode(F.array(*map(F.lit, slacks))).alias("slack")
    reached = (F.col("kappa") >= (1 - F.col("slack")) * F.col("p")).cast("double")
    return kappa(scored, keys).select(*keys, "p", "kappa", every).groupBy(*keys, "slack").agg(F.avg(reached).alias("accuracy"))


def interval_width(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, p, width``: mean width of the intervals of rows that proportion p counts; null where it counts none."""
    return _on_grid(_places(scored, keys, 0.0), keys, "_at").select(*keys, "_at", "p", F.when(F.col("_n") > 0, F.col("_w") / F.col("_n")).alias("width"))


def tightness(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, tightness``: the mean interval width over p, in deviations of the truth (of 1 where it is constant)."""
    return performance(scored, keys).select(*keys, "tightness")


def sigma_of(alpha: float) -> float:
    """Deviations from the mean within which a share ``alpha`` of a normal distribution lies."""
    return NormalDist().inv_cdf((1 + alpha) / 2)


def consensus_tails(scored: DataFrame, keys: list[str], n_sigma: dict[str, float] | None = None, alpha: dict[str, float] | None = None) -> DataFrame:
    """``keys`` with, under each name, the share of rows whose abs(s) is at most that of the limit.

    A limit is a number of deviations or the share of a normal distribution within
    them; n deviations stand for abs(s) <= 2 (1 - Phi(n)).
    """
    limits = {**(n_sigma or {}), **{k: sigma_of(a) for k, a in (alpha or {}).items()}}
    return tail_shares(scored, keys, {k: 2 * (1 - NormalDist().cdf(n)) for k, n in limits.items()})


def consensus_quartiles(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, s25, s50, s75``: quartiles of abs(s), linearly interpolated."""
    return exact_percentiles(scored.withColumn("_a", F.abs("s")), keys, (25.0, 50.0, 75.0), "_a").toDF(*keys, "n", "s25", "s50", "s75").drop("n")


def rejected(rows: DataFrame) -> DataFrame:
    """The rows that ``with_synchronicity`` leaves out: truth, mean or deviation is missing or not finite."""
    return rows.where(~F.coalesce(F.abs(F.col("mu0") + F.col("mu") + F.col("sigma")) < float("inf"), F.lit(False)))
