"""Ranks, running sums and neighbours over one order of all rows, against numpy and windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodecast.operators import histogram, normal_score, ordered, quantiles


def test_running_equals_windows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 2, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3001).alias("x"), (F.col("id") % 13).alias("c"))
    got = ordered.running(ordered.in_order(rows, ["k", "x"]), ["k"], ["x"], ("c",), ("x", "c"), ("x",))
    w = Window.partitionBy("k").orderBy("x")
    want = rows.select("k", "x", "c", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_before"), F.sum("c").over(Window.partitionBy("k")).alias("c_all"), F.lag("x").over(w).alias("x_previous"), F.lag("c").over(w).alias("c_previous"), F.lead("x").over(w).alias("x_following"))
    assert got.drop("_part").exceptAll(want).isEmpty() and got.count() == 3000
    assert ordered.running(ordered.in_order(rows.limit(0), ["k", "x"]), ["k"], ["x"], ("c",)).isEmpty()


def test_parts_are_even_beside_outliers_and_heavy_values(spark):
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 7, 1e18).when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 9).alias("v"))
    counted = rows.groupBy("k", "v").agg(F.count("*").alias("c"))
    sizes = [r["n"] for r in ordered.in_order(counted, ["k", "v"]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == counted.count() and max(sizes) < 1.5 * sum(sizes) / 4
    x = np.array([r["v"] for r in rows.collect()])
    got = quantiles.exact_percentiles(rows, ["k"], (0.0, 25.0, 50.0, 99.9, 100.0)).first()
    assert tuple(got)[1:] == pytest.approx((len(x), *np.percentile(x, [0, 25, 50, 99.9, 100])))


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 12, 57, 1000])
def test_even_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n), 1)  # ties
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", float("nan")), ("b", 2.0), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["quantiles"] for r in quantiles.even_quantiles(rows, ["k"], 10).collect()}
    assert got["a"] == pytest.approx(np.sort(x) if n <= 10 else np.quantile(x, np.linspace(0, 1, 10)), abs=1e-12) and got["b"] == [2.0, 2.0]


def test_gradient_is_the_median_of_positive_slopes(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=800), 2)
    s = np.where(rng.random(800) < 0.2, -v, np.arctan(v))
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(v, s)] + [(1, None, 1.0), (2, 1.0, 1.0)], "k int, v double, score double")
    frame = normal_score.gradient(rows, ["k"])
    at = np.lexsort((s, v))
    slope = np.diff(s[at]) / (1e-9 + np.diff(v[at]))
    assert [tuple(r) for r in frame.collect()] == [(1, pytest.approx(np.median(slope[slope > 0])))]
    assert "percentile" not in frame._jdf.queryExecution().toString()


def test_area_between_distributions_beside_an_outlier(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=2000), rng.normal(1, 2, size=2000)
    a[0] = 1e9
    rows = spark.createDataFrame([(1, float(p), float(q)) for p, q in zip(a, b)] + [(1, None, float("inf")), (2, 1.0, None)], "k int, mu0 double, mu double")
    got = histogram.wasserstein(rows, ["k"]).collect()
    assert [(r["k"], r["d_em"]) for r in got] == [(1, pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean()))]
