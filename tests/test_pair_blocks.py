"""Variograms from blocks of points: few blocks a group, each pair of them met once, none beyond the lag."""

import random

from lodecast.operators import pair_blocks, spatial

POINTS = "domain int, block_id long, x double, y double, z double, v double"


def test_large_groups_become_few_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, *(rng.uniform(0, 100) for _ in range(3)), rng.gauss(0, 1)) for g, n in ((1, 900), (2, 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, POINTS)
    made = pair_blocks.blocks(frame, ["domain"], 50, 100).collect()
    assert sum(r["_n"] for r in made) == 940 and max(r["_n"] for r in made) <= 100
    assert [r["_n"] for r in made if r["domain"] == 2] == [40] and len(made) < 20  # a cell of 8 places each would make more than 100
    monkeypatch.setattr(pair_blocks, "BLOCK", 100)
    monkeypatch.setattr(pair_blocks, "TILE", 16)
    monkeypatch.setattr(pair_blocks.blocks, "__defaults__", (100,))
    for lag, lags in ((20.0, 4), (300.0, 1)):  # 300: every pair lies in one lag, by the boxes alone
        got, want = ({(r["domain"], r["lag"]): (r["n"], round(r["gamma"], 6)) for r in spatial.variogram(frame, ["domain"], lag, lags, whole).collect()} for whole in (0, 4096))
        assert got == want and (lags > 1 or got[1, 0][0] == 900 * 899 // 2)
