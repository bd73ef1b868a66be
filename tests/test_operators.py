"""The statistical engine: every query with SQL against DuckDB, and kernels against closed forms."""

import math
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from lodecast.functions.normal import normal_cdf
from lodecast.operators.kriging import Variogram, krige, krige_point, simulate
from lodecast.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in ("nation", "lineitem", "events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return None if v is None else float(f"{float(v):.9g}") if not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    run = tables.execute(ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(found.columns) == sorted(names)
    expected = sorted((tuple(plain(v) for v in r) for r in run.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in found.select(names).collect()), key=repr) == expected


def test_whole_tables(spark):
    rows, types = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("embeddings", "events"))
    assert QUERIES["prefix_moments_all"](spark, DATA).count() == 3 * rows.count()
    assert QUERIES["attribute_matrix_all"](spark, DATA).count() == types.select("event_type").distinct().count() == 5


def test_normal_cdf(spark):
    places = [-38.0, -9.0, -7.1, -3.3, -1e-9, 0.0, 0.7, 2.0, 7.05, 8.0, 40.0]
    rows = spark.createDataFrame([(z,) for z in places], "z double").selectExpr("z", f"{normal_cdf('z')} AS p").collect()
    for z, p in rows:
        assert p == pytest.approx(NormalDist().cdf(z), abs=1e-14)


def test_kriging_closed_forms(spark):
    model = Variogram(10.0, 2.0)
    one, value = np.array([[0.0, 0.0, 0.0]]), np.array([5.0])
    c = 2 * math.exp(-0.6)
    assert krige_point(one, value, np.array([2.0, 0, 0]), model, None) == pytest.approx((5.0, 2 - c))
    assert krige_point(one, value, np.array([2.0, 0, 0]), model, 3.0) == pytest.approx((3 + c, 2 - c * c / 2))
    points = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, float(i * i)) for i in range(6)], "domain int, block_id long, x double, y double, z double, v double")
    asked = spark.createDataFrame([(1, 10, 2.0, 0.0, 0.0), (1, 11, 2.5, 0.0, 0.0)], "domain int, block_id long, x double, y double, z double")
    got = {r["block_id"]: (r["estimate"], r["variance"]) for r in krige(asked, points, ["domain"], model).collect()}
    assert got[10] == (4.0, 0.0) and 4 < got[11][0] < 9 and got[11][1] > 0
    sims = simulate(asked, points, ["domain"], model, 3, seed=1)
    assert sims.where("block_id = 10 AND value = 4").count() == 3 and sims.count() == 6
    assert sorted(sims.collect()) == sorted(simulate(asked, points, ["domain"], model, 3, seed=1).collect())


def test_sources(spark, tmp_path):
    from lodecast.sources.tables import append_parameters, read_ellipses, read_samples

    (tmp_path / "s.csv").write_text("EAST,NORTH,RL,PL_CU,lookup_domain\n1,2,3,0.5,3310\n1,2,3,,3310\n1,2,3,NaN,3310\n")
    assert [tuple(r) for r in read_samples(spark, str(tmp_path / "s.csv")).collect()] == [(1.0, 2.0, 3.0, 0.5, 3310)]
    (tmp_path / "e.txt").write_text("# ellipses\n%VAR name, A, B\n%VAR angle1 = 10, 20 # degrees\n")
    assert sorted((r["name"], r["angle1"]) for r in read_ellipses(spark, str(tmp_path / "e.txt")).collect()) == [("A", "10"), ("B", "20")]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "p")
    append_parameters(spark, rows.limit(1), path, ["k"])
    append_parameters(spark, rows, path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2]
