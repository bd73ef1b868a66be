"""Joint draws from a factor in tiles against the dense factor."""

import numpy as np
import pytest

from lodecast.operators import gaussian_process as gp
from lodecast.operators import tiles

POINT = "domain int, block_id long, x double, y double, z double, v double"


def _rows(n, group, first, seed):
    rng = np.random.default_rng(seed)
    return [(group, first + i, *map(float, rng.normal(size=3) * 120), float(rng.normal() * 50)) for i in range(n)]


def test_tiles_draw_what_the_dense_factor_draws(spark, monkeypatch):
    known = _rows(100, 1, 0, 1) + _rows(3, 2, 0, 2) + _rows(61, None, 0, 3) + _rows(40, 5, 0, 6) + [(1, 900, 0.0, 0.0, 0.0, 1.0), (1, 901, 0.0, 0.0, 0.0, 5.0)]
    asked = _rows(35, 1, 1000, 4)[::-1] + _rows(2, 2, 1000, 5) + _rows(7, None, 1000, 7) + _rows(40, 4, 0, 8)
    frames = [spark.createDataFrame(rows, POINT).repartition(3) for rows in (asked, known)]
    kernel = gp.Kernel(3000.0, (120.0, 90.0, 150.0), 300.0)

    def drawn():
        return {(r["domain"], r["sim"], r["block_id"]): r["value"] for r in gp.simulate_joint(*frames, ["domain"], kernel, 5, seed=3).collect()}

    want = drawn()
    monkeypatch.setattr(tiles, "TILE", 16)
    monkeypatch.setattr(tiles, "WAVE_BYTES", 1)
    widest = []
    factor = tiles.factor
    monkeypatch.setattr(tiles, "factor", lambda spark, groups, made: (widest.extend(g.width(i) for g in groups for i in range(g.blocks)), factor(spark, groups, made)))
    got = drawn()
    assert len(want) == 5 * (35 + 2 + 7) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    # No task holds a side longer than a tile, and both large groups, that of the null key too, went this way.
    assert max(widest) <= 16 and sum(widest) == 102 + 35 + 61 + 7
