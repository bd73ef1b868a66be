"""Histogram distances between predictions and ground truth, for each group of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import held, numbered
from lodecast.operators.ordered import in_order, running

BINS = 40
DISTANCES = ("d_psi", "d_js", "d_iou", "d_em")


def place(x: Column, at: Column, bins: int) -> Column:
    """The bin in 0..bins+1 of a value ``x`` that lies ``at`` bins above the least edge.

    Bins are closed at the left; 0 and bins + 1 are open, and infinite values lie in them. Null and NaN have none.
    """
    return F.when(x.isNotNull() & ~F.isnan(x), F.floor(F.least(F.greatest(at, F.lit(-1.0)), F.lit(float(bins)))) + 1).cast("int")


def edges(rows: DataFrame, keys: list[str], truth: str, bins: int) -> DataFrame:
    """``keys, _low, _width`` of the bins that span each group's finite truth; a constant truth has bins of width 1."""
    finite = F.when(F.abs(truth) < float("inf"), F.col(truth))
    spans = rows.groupBy(*keys).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    return spans.select(*keys, "_low", F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / bins).otherwise(F.lit(1.0)).alias("_width"))


def bin_codes(rows: DataFrame, keys: list[str], truth: str = "mu0", value: str = "mu", bins: int = BINS) -> DataFrame:
    """``rows`` with ``_truth_bin`` and ``_bin`` in 0..bins+1; the edges span the group's finite truth.

    Bins are closed at the left, and the greatest truth lies in the last open bin, as infinite values do in the open ones.
    A constant truth has bins of width 1. Null and NaN values have no bin.
    """
    spans = held(edges(rows, keys, truth, bins))  # else rows are dealt by group, and a task reads a whole one
    joined = rows.join(spans, keys) if keys else rows.crossJoin(spans)  # without keys, spans have one row
    return joined.withColumns({n: place(F.col(c), (F.col(c) - F.col("_low")) / F.col("_width"), bins) for n, c in (("_truth_bin", truth), ("_bin", value))})


def pmfs(rows: DataFrame, keys: list[str], bins: int = BINS, **columns: str) -> DataFrame:
    """``keys, bin, q, p``: shares of truth (q) and prediction (p) in each bin that either fills."""
    coded = bin_codes(rows, keys, bins=bins, **columns)
    sides = coded.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("_truth_bin").alias("bin")), F.struct(F.lit(0).alias("t"), F.col("_bin").alias("bin")))).alias("s"))
    counts = sides.where("s.bin IS NOT NULL").groupBy(*keys, F.col("s.bin").alias("bin")).agg(F.sum("s.t").alias("nq"), F.sum(1 - F.col("s.t")).alias("np"))
    every = Window.partitionBy(*keys)
    return counts.select(*keys, "bin", *(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)).alias(n) for c, n in (("nq", "q"), ("np", "p"))))


def distances(rows: DataFrame, keys: list[str], truth: str = "mu0", value: str = "mu", bins: int = BINS) -> DataFrame:
    """``keys`` with symmetric chi-square, Jensen-Shannon (base 2), Ruzicka and Wasserstein-1 distances.

    The first three are of the shares that ``pmfs`` has, infinite values included, and need counts of bins alone. The last is the area
    between both distribution functions of finite values: for equal counts the
    mean absolute difference of order statistics of equal rank. Null and NaN
    values of either side are left out, so counts may differ. Equal values are counted
    together first; running sums go over one order of all values, so no task holds a group.
    """
    p, q = F.col("p"), F.col("q")

    def share(x):
        return F.when(x > 0, x * F.log2(x / ((p + q) / 2))).otherwise(0.0)

    binned = pmfs(rows, keys, bins, truth=truth, value=value).groupBy(*keys).agg(
        F.sum(F.when(p + q > 0, (p - q) * (p - q) / (0.5 * (p + q)))).alias("d_psi"),
        F.sum(0.5 * share(p) + 0.5 * share(q)).alias("d_js"),
        (1 - F.sum(F.least(p, q)) / F.sum(F.greatest(p, q))).alias("d_iou"),
    )
    moved = wasserstein(rows, keys, truth, value)
    both = binned.join(moved, keys, "left") if keys else binned.crossJoin(moved)  # without keys, both have one row
    return both.select(*keys, *DISTANCES)


def wasserstein(rows: DataFrame, keys: list[str], truth: str = "mu0", value: str = "mu") -> DataFrame:
    """``keys, d_em``: the area between the distribution functions of both columns' finite values; no row where one has none."""
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)) for c in (truth, value)]
    clean = rows.select(*keys, finite[0].alias("_t"), finite[1].alias("_v"))
    groups = numbered(clean.groupBy(*keys).agg(F.count("*").alias("_size")), "_g")  # one number sorts much faster than the groups' names
    near = clean.join(groups, keys) if keys else clean.crossJoin(groups)
    sides = near.select("_g", F.explode(F.array(*(F.struct(F.col(c).alias("x"), F.lit(t).alias("t")) for c, t in (("_t", 1), ("_v", 0))))).alias("_s"))
    counted = sides.where("_s.x IS NOT NULL").groupBy("_g", F.col("_s.x").alias("_x")).agg(F.sum("_s.t").alias("_nq"), F.sum(1 - F.col("_s.t")).alias("_np"))
    told = running(in_order(counted, ["_g", "_x"]), ["_g"], ["_x"], sums=("_nq", "_np"), following=("_x",))
    gap = F.try_divide(F.col("_nq_before") + F.col("_nq"), F.col("_nq_all")) - F.try_divide(F.col("_np_before") + F.col("_np"), F.col("_np_all"))
    area = F.abs(gap) * (F.col("_x_following") - F.col("_x"))
    moved = told.select("_g", area.alias("_area"), "_nq_all", "_np_all").groupBy("_g").agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("d_em"), F.min(F.least("_nq_all", "_np_all")).alias("_fewest")).where("_fewest > 0")
    return moved.join(groups, "_g").select(*keys, "d_em")


def rank_models(found: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Ranks of models within ``keys`` by each distance, their mean, and the rank of the mean; ties go by model name."""
    group = Window.partitionBy(*keys)
    names = [f"rank_{d[2:]}" for d in DISTANCES]
    ranked = found.select("*", *(F.row_number().over(group.orderBy(F.round(d, 9), model)).alias(n) for d, n in zip(DISTANCES, names, strict=True)))
    mean = ranked.withColumn("rank_avg", sum(F.col(n) for n in names) / len(names))
    return mean.withColumn("rank_overall", F.row_number().over(group.orderBy("rank_avg", model)))


def fixed_histogram(rows: DataFrame, keys: list[str], low: float, high: float, value: str = "v", bins: int = BINS) -> DataFrame:
    """``keys, bin, n, share`` over fixed edges; bins 0 and bins + 1 are open, and ``high`` itself is in the last closed bin."""
    x = F.col(value)
    at = F.when(x == high, bins).otherwise(place(x, (x - low) * bins / (high - low), bins))
    counts = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) + 1e-9))


def divergence(sample: DataFrame, full: DataFrame, keys: list[str], value: str = "v", bins: int = 100) -> DataFrame:
    """``keys, kl``: Kullback-Leibler divergence (natural logarithm) of a sample's shares from those of all rows.

    Bins span all rows' values; a bin that only the sample fills makes it infinite.
    """
    span = held(full.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")))
    width = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / bins).otherwise(1.0)
    at = F.greatest(F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1)), F.lit(0))
    both = sample.select(*keys, value, F.lit(1).alias("_s")).unionByName(full.select(*keys, value, F.lit(0).alias("_s"))).where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = both.join(span, keys).groupBy(*keys, at.alias("bin")).agg(F.sum("_s").alias("_p"), F.sum(1 - F.col("_s")).alias("_q"))
    every = Window.partitionBy(*keys)
    p, q = F.col("_p") / F.sum("_p").over(every), F.col("_q") / F.sum("_q").over(every)
    part = F.when(p == 0, 0.0).when(q == 0, float("inf")).otherwise(p * F.log(p / q))
    return counts.select(*keys, part.alias("_k")).groupBy(*keys).agg(F.sum("_k").alias("kl"))
