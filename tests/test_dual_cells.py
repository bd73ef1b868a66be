"""Variograms from pairs of cells against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodecast.operators import dual_cells, spatial

POINTS = "domain int, block_id long, x double, y double, z double, v double"


def _brute(rows, max_lag, lags):
    sums = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] != b[0]:
                continue
            d = math.sqrt(sum((p - q) * (p - q) for p, q in zip(a[2:5], b[2:5])))
            if d < max_lag:
                one = sums.setdefault((a[0], math.floor(d * lags / max_lag)), [0, 0.0])
                one[0] += 1
                one[1] += (a[5] - b[5]) ** 2 / 2
    return {k: (n, g / n) for k, (n, g) in sums.items()}


@pytest.mark.parametrize("grid", [False, True])
def test_cells_give_what_every_pair_gives(spark, grid):
    rng = random.Random(5)
    rows = []
    for g in range(2):
        for i in range(300):  # clusters, points at one place, and distances that are a lag's edge
            at = [float(rng.randrange(6) * 5) for _ in range(3)] if grid else [rng.gauss(0, rng.choice([0.5, 30])) for _ in range(3)]
            rows.append((g, i, *at, 1e6 + rng.gauss(0, 3)))
    rows += [(g, 300 + i, 7.0, 7.0, 7.0, float(i)) for g in range(2) for i in range(40)]
    frame = spark.createDataFrame(rows, POINTS)
    got = {(r["domain"], r["lag"]): (r["n"], r["gamma"]) for r in spatial.variogram(frame, ["domain"], 30.0, 6, every_pair=0).collect()}
    want = _brute(rows, 30.0, 6)
    assert got.keys() == want.keys()
    for k, (n, g) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(g, rel=1e-6, abs=1e-3)


def test_small_groups_make_pairs_and_large_ones_cells(spark):
    rows = [(g, i, float(i % 7), float(i % 5), float(i % 3), float(i % 11)) for g, n in ((1, 20), (2, 90)) for i in range(n)]
    frame = spark.createDataFrame([*rows, (2, 900, 1.0, 1.0, 1.0, float("nan")), (3, 1, 1.0, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0, 1.0)], POINTS)
    want = {(r["domain"], r["lag"]): (r["n"], round(r["gamma"], 9)) for r in spatial.variogram(frame, ["domain"], 4.0, 4).collect()}
    got = {(r["domain"], r["lag"]): (r["n"], round(r["gamma"], 9)) for r in spatial.variogram(frame, ["domain"], 4.0, 4, every_pair=50).collect()}
    assert got == want and {k[0] for k in want} == {1, 2}
    assert spatial.variogram(frame.limit(0), ["domain"], 4.0, 4, every_pair=0).count() == 0


def test_pairs_made_grow_less_than_squared(spark):
    made = {}
    for n in (1000, 4000):
        at = [(F.rand(i) * 1000).alias(a) for i, a in enumerate("xy")]
        frame = spark.range(n).select(F.lit(1).alias("domain"), F.col("id").alias("block_id"), *at, F.lit(0.0).alias("z"), F.randn(9).alias("v"))
        sums, left, _ = dual_cells.settled(frame, ["domain"], 1000.0, 4)
        points = left.agg(F.coalesce(F.sum(F.col("a._w") * F.col("b._w")), F.lit(0)).alias("n")).first()["n"]
        made[n] = points
        assert sums.agg(F.sum("_n")).first()[0] > 0
    print(made)
    assert made[4000] < 4000**2 / 2 / 4 and made[4000] / made[1000] < 12
