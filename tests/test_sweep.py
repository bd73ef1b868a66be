"""A sweep of families: shared fits, results read again, settings that change only what depends on them."""

import os
import random
from dataclasses import replace

import pytest

from lodecast.operators import sweep, workflow
from lodecast.settings import Settings

POINTS = "domain int, block_id long, x double, y double, z double, v double"


def test_sweep_shares_fits_and_reads_what_is_there(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(g, i, *(rng.uniform(0, 50) for _ in range(3)), rng.gauss(0, 1)) for g in (1, 2) for i in range(60)]
    frame = spark.createDataFrame(rows, POINTS)
    samples, blocks = frame.where("block_id % 6 <> 0"), frame.where("block_id % 6 = 0").drop("v")
    path, settings, keys = str(tmp_path / "sweep"), Settings(rotated=False, max_lag=40.0, lags=8, covariance="exponential"), ["domain"]
    got = sweep.sweep(samples, blocks, keys, path, settings)
    for family, ordinary in sweep.FAMILIES.items():
        want = {(r["domain"], r["block_id"]): r["estimate"] for r in workflow.krige_all(samples, blocks, keys, settings, ordinary=ordinary).collect()}
        own = {(r["domain"], r["block_id"]): r["estimate"] for r in got.where(f"family = '{family}'").collect()}
        assert own.keys() == want.keys() and len(own) == 20
        assert all(own[k] == (None if v is None else pytest.approx(v, abs=1e-9)) for k, v in want.items())
    table = sweep.times(got, sweep.fits(samples, blocks, keys, path, settings), keys).collect()
    assert {(r["domain"], r["family"], r["n_training"], r["n_blocks"]) for r in table} == {(g, f, 50, 10) for g in (1, 2) for f in ("OK", "SK")}
    assert all(r["infer_seconds"] > 0 and r["learn_seconds"] > 0 for r in table)

    def never(*args, **kwargs):
        raise AssertionError("computed again")

    with monkeypatch.context() as m:
        m.setattr(workflow, "fit_all", never)
        m.setattr(workflow, "krige_all", never)
        assert sweep.sweep(samples, blocks, keys, path, settings).count() == 40
    with monkeypatch.context() as m:  # predictions depend on the neighbours, fits do not
        m.setattr(workflow, "fit_all", never)
        assert sweep.sweep(samples, blocks, keys, path, replace(settings, neighbours=5), ("OK",)).count() == 20
    assert len([n for n in os.listdir(path) if n.startswith("fits-")]) == 1
