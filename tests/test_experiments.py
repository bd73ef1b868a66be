"""Sources, settings, the analysis table and the operators' defined results for missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecast.functions import text
from lodecast.operators import analysis, blocks, gaussian_process, histogram, kriging, quantiles, spatial, summary, uncertainty, variogram_fit, workflow
from lodecast.settings import Settings, changed
from lodecast.sources import tables


@pytest.mark.parametrize("kind", ["exponential", "gaussian", "spherical", "matern"])
def test_covariances_are_positive_definite(kind):
    points = np.random.default_rng(1).uniform(0, 300, (60, 3))
    model = kriging.Variogram(200.0, 3000.0, 100.0, kind, radii=(300.0, 200.0, 100.0), angles=(30.0, 20.0, 10.0))
    matrix = model.covariance(model.lags(points[:, None] - points[None]))
    assert np.linalg.eigvalsh(matrix).min() > 0 and matrix[0, 0] == 3000
    assert model.covariance(np.array([1e9]))[0] == pytest.approx(0, abs=1e-9)
    old = kriging.Variogram(10.0, 5.0, 1.0, kind, legacy=True).covariance(np.array([0.0, 20.0]))
    assert old[0] == (1.0 if kind == "matern" else 4.0) and (kind != "spherical" or old[1] == 4.0)


def test_stacked_systems_equal_single_ones():
    rng = np.random.default_rng(2)
    points, values, places = rng.uniform(0, 100, (20, 6, 3)), rng.normal(size=(20, 6)), rng.uniform(0, 100, (20, 3))
    points[3, 1] = points[3, 0]  # two neighbours at one place
    model = kriging.Variogram(80.0, 2.0)
    for means in (None, np.full(20, 0.3)):
        est, var = kriging.krige_points(points, values, places, model, means)
        for i in range(20):
            c = model.covariance(np.sqrt(((points[i] - places[i]) ** 2).sum(-1)))
            left, right = model.covariance(np.sqrt(((points[i][:, None] - points[i][None]) ** 2).sum(-1))), c
            if means is None:
                left, right = np.block([[left, np.ones((6, 1))], [np.ones((1, 6)), np.zeros((1, 1))]]), np.append(c, 1)
            w = np.linalg.lstsq(left, right, rcond=None)[0][:6]
            m = values[i].mean() if means is None else 0.3
            assert est[i] == pytest.approx(m + w @ (values[i] - m), abs=1e-8) and var[i] == pytest.approx(max(0, 2 - w @ c), abs=1e-8)


def test_rotations(spark):
    for sequence in ("xyZ", "yXz", "zyx", "XYZ"):
        m = np.array(spatial.rotation(0.3, 0.5, -0.2, sequence), float)
        assert np.linalg.det(m) == pytest.approx(1) and m @ m.T == pytest.approx(np.eye(3))
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 90.0, 0.0, 0.0, 10.0, 10.0, 10.0)], "x double, y double, z double, angle1 double, angle2 double, angle3 double, search1x double, search1y double, search1z double")
    assert tuple(spatial.rotated(row).select("rx", "ry", "rz").first()) == pytest.approx((2, -1, 3))
    assert tuple(spatial.rotated(row, rotate=False, relative=False, origin=(1.0, 1.0, 1.0)).select("rx", "ry", "rz").first()) == pytest.approx((0, 0.1, 0.2))


def test_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 2.0), ("a", 3.0, 3.0), ("a", nan, inf), ("b", 0.0, 0.5), ("b", 1.0, 2.5)], "model string, mu0 double, mu double")
    found = {r["model"]: r["d_em"] for r in histogram.distances(rows, ["model"]).collect()}
    # Distribution functions of 1, 2, 3 and of 2, 3: 1/3 on [1, 2) and 1/6 on [2, 3).
    assert found["a"] == pytest.approx(1 / 3 + 1 / 6) and found["b"] == pytest.approx(1.0)
    q = quantiles.exact_percentiles(rows, ["model"], (0.0, 50.0, 100.0), "mu0").where("model = 'a'").first()
    assert tuple(q) == ("a", 3, 1.0, 2.0, 3.0)
    big = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 5000 / 7).alias("v"))
    got = quantiles.exact_percentiles(big, ["k"], (2.15, 50.0, 97.85)).first()
    assert tuple(got)[2:] == pytest.approx(np.percentile(np.arange(5000) / 7, [2.15, 50, 97.85]))
    assert quantiles.exact_percentiles(big.limit(0), ["k"], (50.0,)).collect() == []
    scored = spark.createDataFrame([("a", 1.0, 1.0, nan), ("a", None, 1.0, 1.0), ("a", 2.0, 1.0, 1.0)], "model string, mu0 double, mu double, sigma double")
    assert uncertainty.with_synchronicity(scored).count() == 1 and uncertainty.rejected(scored).count() == 2
    points = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, v) for i, v in enumerate([1.0, nan, 3.0, None])], "domain int, block_id long, x double, y double, z double, v double")
    assert [(r["n"], r["gamma"]) for r in spatial.variogram(points, ["domain"], 10.0, 1).collect()] == [(1, 2.0)]
    asked = points.where("block_id = 2").withColumn("block_id", F.lit(9).cast("long"))
    assert {r["block_id"] for r in kriging.simulate(asked, points, ["domain"], kriging.Variogram(10.0, 1.0), 2).collect()} == {9}
    ratio = summary.attribute_ratios(spark.createDataFrame([(1, nan), (2, 9.0)], "k int, v double"), spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, v double"), ["k"], low=0.5, high=1.5)
    got = {r["k"]: r["ratio"] for r in ratio.collect()}
    assert math.isnan(got[1]) and got[2] == 1.5


def test_texts(spark):
    row = spark.createDataFrame([("[1.5  2 3e-4]", [0.25, -1.0]), ("[1, 2]", [1e-9]), ("no", None), ("[a 1]", [])], "t string, v array<double>")
    got = row.select(text.numbers(F.col("t")).alias("n"), text.numbers_text(F.col("v")).alias("x")).collect()
    assert [r["n"] for r in got] == [[1.5, 2.0, 3e-4], [1.0, 2.0], None, None] and got[0]["x"] == "[0.25 -1.0]"
    assert text.path_seeds("04_05_06", "LZ2_3_1_0", 4) == [98117169, 637472315, 513861856, 2044446169]
    assert text.gp_serial("GPR(L)") == "gplr_gbt_lbi" and text.gp_serial("GP-CRF", False, True, "a", "lbe", "g") == "a_gpcrf_lbet_gi_nst"
    own = changed(Settings(), {"max_lag": "500", "simulations": "9999", "rotated": "False"})
    assert (own.max_lag, own.simulations, own.rotated) == (500, 256, False)
    with pytest.raises(ValueError):
        changed(Settings(), {"no_such": "1"})
    with pytest.raises(ValueError):
        Settings(covariance="cubic")


def test_tables(spark, tmp_path):
    for period in ("13_14_15", "14_15_16"):
        (tmp_path / "in" / period).mkdir(parents=True)
        (tmp_path / "in" / period / "blocks_to_estimate_tagged.csv").write_text("X,Y,Z,MINED,cu_bh_nn,cu_50,domain\n1,2,3,13,0.5,0.6,3310\n")
    blocks = tables.read_all_blocks(spark, str(tmp_path / "in"))
    assert sorted((r["period"], r["mu0"]) for r in blocks.collect()) == [(13, 0.5), (14, 0.5)]
    (tmp_path / "g.csv").write_text(",domain_id,angle1,angle2,angle3,search1x,search1y,search1z\nLZ3_3_1_0,3310,10,20,30,100,80,40\n")
    got = spatial.with_geometry(spark.createDataFrame([(3310,), (2210,)], "domain_id int"), tables.read_geometry(spark, str(tmp_path / "g.csv")))
    assert sorted(tuple(r) for r in got.collect()) == [(2210, 0.0, 0.0, 0.0, 300.0, 300.0, 300.0), (3310, 10.0, 20.0, 30.0, 100.0, 80.0, 40.0)]
    (tmp_path / "s.csv").write_text("# mA,domain,n_blastholes,n_inference_pts,a,b,c,d,e,f,g\n4,2310,5,6,1,2,3,4,5,6,7\n")
    assert tuple(tables.read_summary(spark, str(tmp_path / "s.csv")).select("period", "n_inference_pts", "p6").first()) == (4, 6, 7.0)
    (tmp_path / "a.csv").write_text("model,Likelihood\nx,0.5\n")
    (tmp_path / "b.csv").write_text("model,Consensus,T\ny,0.25,1\n")
    assert sorted(tuple(r) for r in tables.read_analysis(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).select("model", "Consensus").collect()) == [("x", 0.5), ("y", 0.25)]
    path = str(tmp_path / "p")
    work = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    runs = []
    for rows in (work.limit(1), work, work):
        found = tables.read_or_compute(spark, path, rows, ["k"], lambda missing: runs.append(missing.count()) or missing)
    assert found.count() == 2 and runs == [1, 1]
    assert sorted(r["v"] or "" for r in tables.known_parameters(spark, spark.createDataFrame([(1,), (9,)], "k int"), path, ["k"]).collect()) == ["", "a"]
    tables.sort_parameters(spark, path, str(tmp_path / "q"), ["k"])
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [1, 2]


def test_analysis_with_variograms(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((1, 60), (2, 5)):
        for i, p in enumerate(rng.uniform(0, 100, (n, 3))):
            truth = float(p[0] / 10 + rng.normal())
            rows += [(d, m, i, *map(float, p), truth, truth + e, 1.0) for m, e in (("exact", 0.0), ("off", float(rng.normal()) * 3))]
    frame = spark.createDataFrame(rows, "domain int, model string, block_id long, x double, y double, z double, mu0 double, mu double, sigma double")
    got = {(r["domain"], r["model"]): r for r in analysis.analysis_table(frame, ["domain"], max_lag=80.0, lags=4).collect()}
    assert len(got) == 4 and got[1, "exact"]["fidelity"] == 1 and got[1, "exact"]["rmse"] == 0 and got[1, "off"]["variogram_ratio"] > 1
    assert got[2, "off"]["fidelity"] is None and got[1, "exact"]["d_rank"] == 1 and got[1, "exact"]["s_low"] == 1
    assert {r["domain"]: r["model"] for r in analysis.best_models(analysis.analysis_table(frame, ["domain"]), ["domain"]).collect()} == {1: "exact", 2: "exact"}
    extra = analysis.with_reference(frame, frame.where("model = 'exact'").withColumn("reference", F.col("mu0") + 1), ["domain"], "long range")
    assert extra.where("model = 'long range'").count() == 65
    assert gaussian_process.Kernel(1.0, (1.0, 2.0, 4.0), 0.1).isotropic().lengths == pytest.approx((2.0, 2.0, 2.0))


def test_workflow_predicts_the_field(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 300, (400, 3))
    value = np.sin(points[:, 0] / 60) * 10 + points[:, 1] / 50
    data = [(1, i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(points, value, strict=True))]
    frame = spark.createDataFrame(data, "domain int, block_id long, x double, y double, z double, v double")
    known, asked = frame.where("block_id % 5 <> 0"), frame.where("block_id % 5 = 0")
    geometry = spark.createDataFrame([(1, 20.0, 5.0, 5.0, 200.0, 150.0, 100.0)], "domain_id int, angle1 double, angle2 double, angle3 double, search1x double, search1y double, search1z double")
    for settings in (Settings(max_lag=200.0, lags=20), Settings(max_lag=200.0, lags=20, scored=True)):
        found = workflow.krige_all(known, asked.drop("v"), ["domain"], settings, geometry if not settings.scored else None)
        rows = found.join(asked.select("domain", "block_id", "v"), ["domain", "block_id"]).collect()
        assert len(rows) == 80 and math.sqrt(np.mean([(r["estimate"] - r["v"]) ** 2 for r in rows])) < 0.5 * value.std() and all(r["deviation"] >= 0 for r in rows)
    near = workflow.adjusted(known, ["domain"], 60.0)
    assert near.count() == known.count() and near.where("local_mean IS NULL").count() == 0


def test_infinite_values_lie_in_the_open_bins(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([("a", float(i), float(i)) for i in range(10)] + [("a", 3.0, inf), ("a", 4.0, -inf), ("a", inf, 1e300), ("a", nan, -1e300), ("b", 1.0, None)], "model string, mu0 double, mu double")
    found = {(r["model"], r["bin"]): (r["q"], r["p"]) for r in histogram.pmfs(rows, ["model"]).collect()}
    assert found["a", 0][1] == pytest.approx(2 / 14) and found["a", 41] == pytest.approx((2 / 13, 3 / 14))  # 9 itself, inf and 1e300 above
    counts = {r["bin"]: r["n"] for r in histogram.fixed_histogram(rows, [], 0.0, 9.0, "mu").collect()}
    assert counts[0] == 2 and counts[41] == 2 and counts[40] == 1
    assert sum(r["n"] for r in histogram.fixed_histogram(rows, ["model"], 0.0, 9.0, "mu0").collect()) == 14
    told = {r["model"]: r for r in histogram.distances(rows, ["model"]).collect()}
    assert told["a"]["d_psi"] > 0 and told["b"]["d_em"] is None
    # Shares and distances are of the same bins.
    by_hand = sum((p - q) ** 2 / (0.5 * (p + q)) for (m, _), (q, p) in found.items() if m == "a")
    assert told["a"]["d_psi"] == pytest.approx(by_hand)


def test_groups_are_numbered_apart(spark, monkeypatch):
    side = spark.range(500).select(F.col("id").alias("k")).repartition(7)
    monkeypatch.setattr(blocks, "HELD_GROUPS", 100)
    assert sorted(r["n"] for r in blocks.numbered(side, "n").collect()) == list(range(500))
    monkeypatch.setattr(blocks, "HELD_GROUPS", 1000)
    assert sorted(r["n"] for r in blocks.numbered(side, "n").collect()) == list(range(500))


def test_workflow_keeps_every_block(spark):
    rng = np.random.default_rng(4)
    points = "domain int, block_id long, x double, y double, z double, v double"

    def some(domain, n, start, values=True):
        return [(domain, start + i, *map(float, rng.uniform(0, 100, 3)), float(rng.normal(50, 5)) if values else None) for i in range(n)]

    samples = spark.createDataFrame(some(1, 60, 0) + some(2, 12, 0), points)
    asked = spark.createDataFrame([r[:5] for d, n in ((1, 5), (2, 4), (3, 3)) for r in some(d, n, 1000)], points.rsplit(",", 1)[0])
    for scored in (False, True):
        settings = Settings(max_lag=80.0, lags=8, scored=scored)
        found = workflow.krige_all(samples, asked, ["domain"], settings).collect()
        assert sorted((r["domain"], r["block_id"]) for r in found) == sorted((r["domain"], r["block_id"]) for r in asked.collect())
        told = {d: [r["estimate"] for r in found if r["domain"] == d] for d in (1, 2, 3)}
        assert told[3] == [None] * 3 and all(30 < v < 70 for d in (1, 2) for v in told[d])
    # Twelve samples are too few for scores: the group is as without.
    plain = {r["block_id"]: r["estimate"] for r in workflow.krige_all(samples, asked, ["domain"], Settings(max_lag=80.0, lags=8)).collect() if r["domain"] == 2}
    assert {r["block_id"]: r["estimate"] for r in found if r["domain"] == 2} == pytest.approx(plain)
    all_scored = {r["block_id"]: r["estimate"] for r in workflow.krige_all(samples, asked, ["domain"], Settings(max_lag=80.0, lags=8, scored=True, least_scored=5)).collect() if r["domain"] == 2}
    assert all_scored != pytest.approx(plain)
    sims = workflow.simulate_all(samples, asked.where("domain < 3"), ["domain"], kriging.Variogram(50.0, 1.0), Settings(max_lag=80.0, simulations=4)).collect()
    assert len(sims) == 4 * 9 and all(r["value"] is not None for r in sims)


def test_parameters_from_a_table_search_within_the_lag(spark):
    points = "domain int, block_id long, x double, y double, z double, v double"
    samples = spark.createDataFrame([(1, i, float(10 * i), 0.0, 0.0, float(i)) for i in range(30)], points)
    asked = spark.createDataFrame([(1, 99, 95.0, 0.0, 0.0, 0.0)], points).drop("v")
    given = spark.createDataFrame([(1, 400.0, 2.0, 0.0)], "domain int, range double, sill double, nugget double")
    # Half of max_lag holds two samples, half of the range twenty: the two neighbours alone decide.
    got = workflow.krige_all(samples, asked, ["domain"], Settings(max_lag=20.0, covariance="exponential"), parameters=given).first()
    model = kriging.Variogram(400.0, 2.0)
    want = kriging.krige_point(np.array([[90.0, 0, 0], [100.0, 0, 0]]), np.array([9.0, 10.0]), np.array([95.0, 0, 0]), model, None)
    assert (got["estimate"], got["deviation"]) == pytest.approx((want[0], math.sqrt(want[1])))


def test_bounds_of_fits_are_the_variance(spark):
    x = np.arange(1, 21) * 10.0
    curves = spark.createDataFrame([(1, i, float(3.0 * (1 - math.exp(-3 * h / 50)))) for i, h in enumerate(x)] + [(2, i, 1.0) for i in range(20)], "k int, lag int, gamma double")
    bound = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, variance double")
    got = {r["k"]: r for r in variogram_fit.fit(curves, ["k"], 10.0, "exponential", nugget=False, variances=bound).collect()}
    assert got[1]["sill"] == pytest.approx(2.0) and got[2]["sill"] is None
    assert variogram_fit.value_variances(spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("inf"))], "k int, v double"), ["k"]).first()["variance"] == 1.0


def test_known_parameters_without_a_table(spark, tmp_path):
    got = tables.known_parameters(spark, spark.createDataFrame([(1,)], "k int"), str(tmp_path / "none"), ["k"]).first()
    assert got.asDict() == {"k": 1, "range": None, "sill": None, "nugget": None}
