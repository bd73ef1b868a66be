"""Training from every start as a task of its own, and solutions by blocks."""

import numpy as np
import pytest

from lodecast.operators import gaussian_process as gp

POINT = "domain int, block_id long, x double, y double, z double, v double"


def test_triangles_by_blocks():
    rng = np.random.default_rng(4)
    low = np.tril(rng.normal(size=(50, 50))) * 0.1 + 2 * np.eye(50)
    for right in (rng.normal(size=50), rng.normal(size=(50, 3))):
        assert np.allclose(low @ gp.solve_lower(low, right, 16), right)
    assert np.allclose(gp.inverse_lower(low, 16) @ low, np.eye(50))


def test_each_start_is_a_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, i, *map(float, rng.normal(size=3) * 100), float(rng.normal())) for g in (1, 2) for i in range(25)]
    frame = spark.createDataFrame(rows, POINT)
    got = {r["domain"]: r for r in gp.train(frame, ["domain"], restarts=2).collect()}
    assert len(gp.starts(2, 0)) == 3
    for g, r in got.items():
        own = np.array([p[2:] for p in rows if p[0] == g])
        kernel, value = gp.optimise(own[:, :3], own[:, 3], restarts=2)
        assert r["n"] == 25 and r["nlml"] == pytest.approx(value) and r["amplitude"] == pytest.approx(kernel.amplitude, rel=1e-3)
