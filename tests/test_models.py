"""Model operators against closed forms, direct numpy forms and exact round trips."""

import math

import numpy as np
import pytest

from lodecast.operators import downsample, gaussian_process as gp, normal_score, significance, spatial, variogram_fit
from lodecast.operators.kriging import Variogram, bessel_k

POINT = "domain int, block_id long, x double, y double, z double, v double"


def cloud(n, seed=0, domain=1):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 300, (n, 3))
    return [(domain, i, *map(float, p), float(math.sin(p[0] / 60) * 10 + p[1] / 50)) for i, p in enumerate(xyz)]


def test_t_distribution_and_tests(spark):
    assert significance.t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-13)  # Cauchy
    assert significance.t_cdf(-2.0, 2) == pytest.approx(0.5 - 1 / math.sqrt(6), abs=1e-13)
    assert significance.t_cdf(0.0, 7) == 0.5 and significance.t_cdf(50.0, 1e6) == pytest.approx(1)
    assert significance.t_quantile(0.975, 1) == pytest.approx(12.706204736432095)
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 1.5), ("a", 4.0, 2.0), ("a", None, 2.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in significance.t_test(rows, ["k"], "x", "y").collect()}
    assert got["a"]["t"] == pytest.approx(7 / 6 / (math.sqrt(7 / 12) / math.sqrt(3))) and got["a"]["df"] == 2
    assert got["a"]["low"] < 7 / 6 < got["a"]["high"] and got["b"]["t"] is None
    welch = {r["k"]: r for r in significance.t_test(rows, ["k"], "x", "y", "welch", "two-sided").collect()}
    x, y = np.array([1.0, 2, 4]), np.array([0, 1.5, 2, 2])
    va, vb = x.var(ddof=1) / 3, y.var(ddof=1) / 4
    assert welch["a"]["t"] == pytest.approx((x.mean() - y.mean()) / math.sqrt(va + vb))
    assert welch["a"]["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 2 + vb**2 / 3))


def test_bessel_and_matern():
    x = np.array([0.01, 0.5, 3.0, 20.0])
    assert bessel_k(0.5, x) == pytest.approx(np.sqrt(np.pi / 2 / x) * np.exp(-x), rel=1e-12)
    assert bessel_k(1.5, x) == pytest.approx(np.sqrt(np.pi / 2 / x) * np.exp(-x) * (1 + 1 / x), rel=1e-12)
    assert Variogram(10.0, 2.0, kind="matern", smoothness=0.5).covariance(np.array([5.0])) == pytest.approx(2 * math.exp(-4 * 0.5 * math.sqrt(0.5)))


@pytest.mark.parametrize("kind", variogram_fit.SHAPES)
def test_variogram_fit_finds_its_own_curve(spark, kind):
    x = (np.arange(20) + 1) * 10.0
    y = 0.3 + 1.7 * variogram_fit.rise(x / 120, kind)
    curves = spark.createDataFrame([(1, i, float(g)) for i, g in enumerate(y)] + [(2, 0, 1.0)], "domain int, lag long, gamma double")
    got = {r["domain"]: r for r in variogram_fit.fit(curves, ["domain"], 10.0, kind).collect()}
    assert got[1]["range"] == pytest.approx(120, rel=1e-2) and got[1]["sill"] == pytest.approx(2, rel=1e-2)
    assert got[1]["nugget"] == pytest.approx(0.3, abs=2e-2)
    assert got[2]["range"] is None or math.isnan(got[2]["range"])


def test_normal_scores_round_trip(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 2, 2, 9, 5, 7])] + [(2, i, float(i * i)) for i in range(1500)], "domain int, block_id long, v double")
    fitted = normal_score.quantiles(rows, ["domain"])
    scores = normal_score.transform(rows, fitted, ["domain"])
    assert scores.where("domain = 1 AND v = 5").first()["score"] == pytest.approx(0.43072729929545756)  # 4 of 6 steps
    assert scores.where("domain = 1 AND v = 9").first()["score"] == pytest.approx(5.199337582)
    back = normal_score.inverse(scores.withColumnRenamed("v", "was"), fitted, ["domain"])
    assert back.count() == 1507 and back.where("abs(v - was) > 1e-6 * (1 + was)").count() == 0


def test_downsample(spark):
    rows = spark.createDataFrame(cloud(200) + cloud(10, 1, 2), POINT)
    got = downsample.downsample(rows, ["domain"], 30, workers=2, trials=5)
    assert {r["domain"]: r["count"] for r in got.groupBy("domain").count().collect()} == {1: 30, 2: 10}
    assert sorted(got.collect()) == sorted(downsample.downsample(rows, ["domain"], 30, workers=2, trials=5).collect())
    assert downsample.downsample(rows.limit(0), ["domain"], 30).count() == 0


def test_likelihood_gradient():
    data = np.array([r[2:] for r in cloud(25)])
    theta = np.log([2.0, 200, 150, 90, 0.5])
    for kind in ("matern32", "rbf"):
        f, g = gp.likelihood(theta, data[:, :3], data[:, 3] - data[:, 3].mean(), kind)
        rises = [(gp.likelihood(theta + 1e-5 * u, data[:, :3], data[:, 3] - data[:, 3].mean(), kind)[0] - f) / 1e-5 for u in np.eye(5)]
        assert g == pytest.approx(rises, rel=1e-3, abs=1e-3)
    kernel, found = gp.optimise(data[:, :3], data[:, 3], restarts=1)
    assert found < gp.likelihood(np.log([1, 300, 300, 100, 1]), data[:, :3], data[:, 3] - data[:, 3].mean(), "matern32")[0]


def test_gaussian_process_prediction(spark, monkeypatch):
    data = cloud(60)
    known, asked = spark.createDataFrame(data[:50], POINT), spark.createDataFrame(data[50:], POINT)
    kernel = gp.Kernel(50.0, (100.0, 120.0, 140.0), 0.5)
    t = np.array([r[2:] for r in data[:50]])
    k = kernel.between(t[:, :3], t[:, :3]) + (0.5 + gp.JITTER) * np.eye(50)
    monkeypatch.setattr(gp, "BLOCK_ROWS", 3)
    got = {r["block_id"]: r for r in gp.infer_global(asked, known, ["domain"], kernel).collect()}
    assert len(got) == 10
    for r in data[50:]:
        c = kernel.between(t[:, :3], np.array([r[2:5]]))[:, 0]
        assert got[r[1]]["estimate"] == pytest.approx(t[:, 3].mean() + c @ np.linalg.solve(k, t[:, 3] - t[:, 3].mean()))
        assert got[r[1]]["variance"] == pytest.approx(50.5 - c @ np.linalg.solve(k, c))
    wide = {r["block_id"]: r for r in gp.infer_local(asked, known, ["domain"], kernel, k=400, radius=1000.0).collect()}
    for i, r in got.items():
        assert wide[i]["estimate"] == pytest.approx(r["estimate"]) and wide[i]["variance"] == pytest.approx(r["variance"])
    joint = gp.simulate_joint(asked, known, ["domain"], kernel, 400)
    for r in joint.groupBy("block_id").agg({"value": "avg"}).collect():
        assert abs(r[1] - got[r[0]]["estimate"]) < 5 * math.sqrt(got[r[0]]["variance"] / 400)
    assert gp.simulate_sequential(asked, known, ["domain"], kernel, 2).count() == 20


def test_ratio_of_equal_curves(spark):
    curves = spark.createDataFrame([(1, m, i, 1.0 + i) for m in ("truth", "same") for i in range(4)] + [(1, "truth", 9, 4.0)], "domain int, model string, lag long, gamma double")
    for r in spatial.variogram_ratios(curves, ["domain"], "truth").collect():
        assert (r["p25"], r["p50"], r["p75"], r["fidelity"]) == (1, 1, 1, 1)


def test_grid_place_equals_a_search(spark):
    from bisect import bisect_left

    from pyspark.sql import functions as F

    from lodecast.operators.uncertainty import _place, probability_grid

    grid = probability_grid()
    asked = [0.0, 1.0, 0.999999, 1e-12, *grid, *np.nextafter(grid, 2).tolist(), *np.nextafter(grid, -1).tolist(), *np.random.default_rng(0).uniform(0, 1, 500).tolist()]
    found = spark.createDataFrame([(v,) for v in asked], "v double").select("v", _place(F.col("v")).alias("at")).collect()
    assert [r["at"] for r in found] == [bisect_left(grid, r["v"]) + 1 for r in found]


def test_kriging_serials():
    from lodecast.operators.summary import kriging_serial

    assert kriging_serial("OK-SGS", scored=True) == "oksgsr_bt_bi_nst"
    assert kriging_serial("SK", rotated=False, prefix="a") == "a_sk_bt_bi"


def test_registered_queries_do_the_whole_job(spark, monkeypatch):
    from lodecast.queries import QUERIES, REALISATIONS

    data = "/root/testdata/sf0.1"
    every = spark.read.parquet(f"{data}/embeddings.parquet")
    assert QUERIES["downsample"](spark, data).count() == every.count()  # no domain has more points than are trained on
    sims = QUERIES["gp_crf"](spark, "/root/testdata/sf0.001")
    places = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 5 = 0").count()
    assert REALISATIONS == 128 and sims.select("sim").distinct().count() == 128 and sims.count() == 128 * places
    # Training sees every point, with the operator's own number of restarts.
    asked = []
    monkeypatch.setattr(gp, "train", lambda known, keys, **options: asked.append((known.count(), options)) or known.select("v"))
    QUERIES["gp_train"](spark, data)
    assert asked == [(every.count(), {})]


def test_searches_of_joins_and_of_sequential_steps_agree(spark):
    from lodecast.operators import kriging

    # Clustered points: without octants, all neighbours come from one side.
    rng = np.random.default_rng(3)
    dense = [(1, i, *map(float, p), 0.0) for i, p in enumerate(rng.uniform(0, 10, (40, 3)))]
    data = dense + [(1, 100 + i, *map(float, p), 0.0) for i, p in enumerate(rng.uniform(-60, 60, (40, 3)))]
    known = spark.createDataFrame(data, POINT)
    places = [(1, 500, -1.0, -1.0, -1.0, 0.0), (1, 501, 30.0, -20.0, 5.0, 0.0), (1, 502, 400.0, 0.0, 0.0, 0.0)]
    asked = spark.createDataFrame(places, POINT)
    points, radii, angles = np.array([r[2:5] for r in data]), (60.0, 25.0, 40.0), (35.0, 20.0, 50.0)

    def chosen(frame):
        out = {}
        for r in sorted(frame.collect(), key=lambda r: (r["q_id"], r["rank"])):
            out.setdefault(r["q_id"], []).append(r["block_id"])
        return out

    octants, ellipsoid = chosen(spatial.neighbours(asked, known, ["domain"], 50.0, 9)), chosen(spatial.ellipsoid_neighbours(asked, known, ["domain"], radii, angles))
    for _, i, *place, _ in places:
        delta = points - np.array(place)
        assert [data[j][1] for j in kriging.octant_search(delta, 9, 50.0)] == octants[i]
        assert [data[j][1] for j in gp.ellipsoid_search(delta, 9, radii, angles)] == ellipsoid[i]
    assert len(octants[502]) == 2 and len(ellipsoid[502]) == 3 and any(i >= 100 for i in octants[500])
    # The first step of a realisation conditions on these points.
    step = kriging.simulate(asked.limit(1), known, ["domain"], Variogram(100.0, 1.0), 1, point=lambda p, v, at, mean: (float(p[:, 0].sum()), 0.0))
    assert step.first()["value"] == pytest.approx(sum(points[[r[1] for r in data].index(i)][0] for i in octants[500]))
    # Turned by the same formula as the geometry of domains.
    row = spark.createDataFrame([(3.0, -2.0, 5.0, *angles, 1.0, 1.0, 1.0)], "x double, y double, z double, angle1 double, angle2 double, angle3 double, search1x double, search1y double, search1z double")
    assert tuple(spatial.rotated(row).select("rx", "ry", "rz").first()) == pytest.approx(spatial.turned(3.0, -2.0, 5.0, angles))
