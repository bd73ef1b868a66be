"""Groups beyond a thousand values or the training limit: exact scores, whole counts, lists of nearest rows, small sides held."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecast.functions.normal import normal_quantile
from lodecast.operators import downsample, histogram, normal_score, summary, sweep
from lodecast.settings import Settings

POINTS = "domain int, block_id long, x double, y double, z double, v double"


def test_exact_scores_of_more_than_a_thousand_values(spark):
    values = [random.Random(i).choice([float(i), float(i % 7)]) ** 2 for i in range(2500)]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(1, -1, None), (2, 0, 5.0)], "domain int, block_id long, v double")
    told = normal_score.ranks(frame, ["domain"])
    scores = normal_score.exact_transform(frame, told, ["domain"])
    rows = normal_score.exact_inverse(scores, told, ["domain"], into="back").collect()
    got = {(r["domain"], r["block_id"]): r for r in rows}
    assert len(rows) == 2502 and got[1, -1]["back"] is None and got[2, 0]["back"] == 5.0 and got[2, 0]["score"] == 0.0
    order = sorted(values)
    first = {v: i for i, v in reversed(list(enumerate(order)))}
    middles = [min(max((first[v] + (order.count(v) - 1) / 2) / 2499, 1e-7), 1 - 1e-7) for v in values]
    want = [r["z"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(middles)], "i int, p double").coalesce(1).select("i", F.expr(normal_quantile("p")).alias("z")).orderBy("i").collect()]
    for i, v in enumerate(values):
        assert got[1, i]["score"] == pytest.approx(want[i], abs=1e-9) and got[1, i]["back"] == pytest.approx(v, abs=1e-6)


def test_training_counts_are_taken_before_the_limit(spark, tmp_path):
    rng = random.Random(2)
    frame = spark.createDataFrame([(1, i, *(rng.uniform(0, 50) for _ in range(3)), rng.gauss(0, 1)) for i in range(60)], POINTS)
    samples, blocks, settings = frame.where("block_id % 6 <> 0"), frame.where("block_id % 6 = 0").drop("v"), Settings(rotated=False, max_lag=40.0, lags=8, training_points=20)
    assert [r["n"] for r in sweep.fits(samples, blocks, ["domain"], str(tmp_path / "sweep"), settings).collect()] == [50]


def test_nearest_rows_are_found_once():
    points = np.random.default_rng(1).normal(size=(700, 3))
    near = downsample.nearest(points, np.arange(700), 9)
    for i in (0, 300, 699):
        assert set(near[i]) == set(np.argsort(((points - points[i]) ** 2).sum(1))[:9])
    got = downsample.patches(near, 50, np.random.default_rng(2))
    assert len(set(got)) == 50


def test_small_sides_go_to_the_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of unknown size
    try:
        rows = spark.range(100).selectExpr("id % 2 AS domain", "double(id) AS mu0", "double(id) AS mu")
        for plan in (histogram.bin_codes(rows, ["domain"]), summary.available(rows, rows.where("mu > 90"), ["domain"]), histogram.divergence(rows, rows, ["domain"], "mu")):
            assert "SortMergeJoin" not in plan._jdf.queryExecution().toString()
        assert summary.available(rows, rows.where("mu = 90"), ["domain"]).count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
