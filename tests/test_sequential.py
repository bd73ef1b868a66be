"""Sequential realisations from neighbours found once against those that go from step to step."""

import numpy as np
import pytest

from lodecast.operators import gaussian_process as gp
from lodecast.operators import kriging, sequential

POINT = "domain int, block_id long, x double, y double, z double, v double"


def _rows(n, group, first, seed, scale=120.0):
    rng = np.random.default_rng(seed)
    return [(group, first + i, *map(float, rng.normal(size=3) * scale), float(rng.normal() * 50)) for i in range(n)]


def _grid(n, group, first, seed):
    """Points on a coarse grid, many at one place: ties wherever one looks."""
    rng = np.random.default_rng(seed)
    return [(group, first + i, *map(float, rng.integers(-3, 4, size=3) * 40), float(rng.normal() * 50)) for i in range(n)]


def _steps(asked, known, kernel, sims, k, radii, angles):
    """The form of before: every step scans all points before it."""
    prior = kriging.Variogram(1.0, kernel.amplitude + kernel.noise)
    return kriging.simulate(asked, known, ["domain"], prior, sims, k, 3, point=lambda p, v, at, _: gp.point(p, v, at, kernel), search=lambda delta: gp.ellipsoid_search(delta, k, radii, angles))


def _drawn(frame):
    return {(r["domain"], r["sim"], r["block_id"]): r["value"] for r in frame.collect()}


@pytest.mark.parametrize(("k", "radii", "angles", "listed"), [(9, (150.0,) * 3, (0.0,) * 3, 24), (9, (150.0, 90.0, 40.0), (30.0, 10.0, 5.0), 3), (2, (20.0,) * 3, (0.0,) * 3, 1)])
def test_steps_in_waves_draw_what_single_steps_draw(spark, monkeypatch, k, radii, angles, listed):
    known = _rows(300, 1, 0, 1) + _rows(2, 2, 0, 2) + _rows(40, None, 0, 3) + _grid(150, 5, 0, 4) + _rows(5, 7, 0, 5) + [(1, 900, 1.0, 2.0, 3.0, None), (8, 0, 0.0, 0.0, 0.0, 1.0)]
    asked = _rows(90, 1, 1000, 6)[::-1] + _rows(70, 2, 1000, 7) + _rows(30, None, 1000, 8) + _grid(120, 5, 1000, 9) + _grid(60, 4, 1000, 10)
    asked += [(7, 1000 + i, 50.0, 60.0, 70.0, 0.0) for i in range(40)] + [(7, 1100 + i, 51.0 + i % 2, 60.0, 70.0, 0.0) for i in range(40)] + [(7, 1200, *known[-6][2:5], 0.0)]
    frames = [spark.createDataFrame(rows, POINT).repartition(3) for rows in (asked, known)]
    kernel = gp.Kernel(3000.0, (120.0, 90.0, 150.0), 300.0)
    want = _drawn(_steps(*frames, kernel, 5, k, radii, angles))
    monkeypatch.setattr(sequential, "LISTED", listed)
    monkeypatch.setattr(sequential, "WHOLE", 100)  # smaller groups are searched in a task, larger ones by blocks
    monkeypatch.setattr(sequential, "SIZE", 8)
    monkeypatch.setattr(sequential, "TOGETHER", 50)
    monkeypatch.setattr(sequential, "TASK_STEPS", (200, 200))
    got = _drawn(gp.simulate_sequential(*frames, ["domain"], kernel, 5, k, 3, radii, angles))
    assert len(want) == 5 * len(asked) and got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-6) for key in want)


def test_no_step_scans_the_points_before_it(spark, monkeypatch):
    asked, known = _rows(400, 1, 10000, 1), _rows(1600, 1, 0, 2)
    frames = [spark.createDataFrame(rows, POINT) for rows in (asked, known)]
    kernel = gp.Kernel(3000.0, (120.0,) * 3, 300.0)

    def none(*_):
        raise AssertionError("a step was searched, or predicted, by itself")

    monkeypatch.setattr(gp, "point", none)
    monkeypatch.setattr(gp, "ellipsoid_search", none)
    assert gp.simulate_sequential(*frames, ["domain"], kernel, 3).where("abs(value) < double('infinity')").count() == 1200


def test_sets_of_neighbours_are_solved_once_for_all_realisations(monkeypatch):
    asked, known = np.array([r[2:] for r in _rows(400, 1, 0, 1)]), np.array([r[2:] for r in _rows(1600, 1, 0, 2)])
    kernel, search = gp.Kernel(3000.0, (120.0,) * 3, 300.0), sequential.Search(9, (150.0,) * 3, (0.0,) * 3)
    lists = sequential.searched(asked[:, :3].T, known[:, :3].T, known[:, 3], asked[:, :3].T, np.arange(400), np.full(400, np.inf), search)
    systems, steps = [], []
    weights, step = sequential.weights, sequential.Lists.searched
    monkeypatch.setattr(sequential, "weights", lambda points, *others: (systems.append(len(points)), weights(points, *others))[1])
    monkeypatch.setattr(sequential.Lists, "searched", lambda self, own, *others: (steps.append(len(own)), step(self, own, *others))[1])
    out = sequential.realisations(asked[:, :3], *(lists[c].to_list() for c in ("known", "near", "lags")), lists["reach"].to_numpy(), 0.0, kernel, gp.JITTER, search, 0, range(64))
    assert out.shape == (64, 400) and np.isfinite(out).all()
    assert sum(steps) == 0 and 400 < sum(systems) < 64 * 400 / 4


def test_queries_without_a_place_have_no_value(spark):
    asked, known = _rows(20, 1, 1000, 1), _rows(50, 1, 0, 2)
    lost = [(1, 2000, float("nan"), 0.0, 0.0, None), (1, 2001, None, 0.0, 0.0, None)]
    kernel = gp.Kernel(3000.0, (120.0,) * 3, 300.0)
    drawn = _drawn(gp.simulate_sequential(spark.createDataFrame(asked + lost, POINT), spark.createDataFrame(known, POINT), ["domain"], kernel, 2))
    assert len(drawn) == 44 and all((value is None) == (block >= 2000) for (_, _, block), value in drawn.items())
    assert _drawn(gp.simulate_sequential(spark.createDataFrame([], POINT), spark.createDataFrame(known, POINT), ["domain"], kernel, 2)) == {}
