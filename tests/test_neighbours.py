"""Neighbour joins by cells of counts against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodecast.operators import cells, nearest

POINTS = "domain int, block_id long, x double, y double, z double, v double"


def _octant(d):
    return sum((2**i) * (c < 0) for i, c in enumerate(d))


def _chosen(queries, known, radius, k, least, octants):
    out = set()
    for g, q, *at, _ in queries:
        if not all(c is not None and math.isfinite(c) for c in at):
            continue
        told = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(p[2:5], at))), p[1], _octant([a - b for a, b in zip(p[2:5], at)])) for p in known if p[0] == g and all(c is not None and math.isfinite(c) for c in p[2:5]))
        near = [t for t in told if (t[0] < radius if octants else t[0] <= radius)]
        near = near if len(near) >= least else told[:least]
        if octants:
            first = [t for o in range(8) for t in [n for n in near if n[2] == o][: max(k // 8, 1)]]
            near = sorted((sorted(first) + [n for n in near if n not in first])[:k])
        out |= {(g, q, p, o, r + 1) for r, (_, p, o) in enumerate(near[:k])}
    return out


def _clustered(rng, n, group, start):
    """Points of densities that differ a thousandfold, some equal, some on one plane."""
    rows = []
    for i in range(n):
        scale = rng.choice([0.05, 1, 50])
        at = [rng.gauss(0, scale) + (100 if scale == 0.05 else 0) for _ in range(3)]
        rows.append((group, start + i, *(at if i % 5 else [at[0], at[1], 0.0]), rng.gauss(0, 1)))
    return rows


@pytest.mark.parametrize(("radius", "k", "least", "octants"), [(3.0, 9, 2, True), (500.0, 16, 2, True), (0.5, 9, 3, False), (1000.0, 20, 3, False)])
def test_same_neighbours_as_every_pair(spark, monkeypatch, radius, k, least, octants):
    monkeypatch.setattr(nearest, "WHOLE", 40)
    monkeypatch.setattr(cells, "LEAF", 8)
    monkeypatch.setattr(cells, "PASS", 1)
    monkeypatch.setattr(cells.Tree.of.__func__, "__defaults__", (8, None, None))
    rng = random.Random(radius)
    known = _clustered(rng, 400, 1, 0) + _clustered(rng, 30, 2, 0) + [(1, 1000 + i, 7.0, 7.0, 7.0, 1.0) for i in range(60)]
    known += [(1, 2000, None, 1.0, 1.0, 1.0), (1, 2001, math.nan, 1.0, 1.0, 1.0), (1, 2002, math.inf, 1.0, 1.0, 1.0), (3, 1, 0.0, 0.0, 0.0, 1.0)]
    queries = _clustered(rng, 60, 1, 0) + _clustered(rng, 10, 2, 0) + [(1, 100, 7.0, 7.0, 7.0, 0.0), (3, 5, 9.0, 9.0, 9.0, 0.0), (4, 1, 0.0, 0.0, 0.0, 0.0), (1, 101, 1e6, 0.0, 0.0, 0.0), (1, 102, None, 0.0, 0.0, 0.0)]
    found = nearest.neighbours(spark.createDataFrame(queries, POINTS).repartition(3), spark.createDataFrame(known, POINTS).repartition(5), ["domain"], radius, k, least, octants)
    assert {(r.domain, r.q_id, r.block_id, r.octant, r["rank"]) for r in found.collect()} == _chosen(queries, known, radius, k, least, octants)


def test_points_met_do_not_grow_with_density(spark):
    rng = random.Random(5)
    met = {}
    for n in (1000, 8000):
        rows = [(1, i, rng.random(), rng.random(), rng.random(), 0.0) for i in range(n)]
        queries = spark.createDataFrame(rows[:200], POINTS)
        # A radius that holds every point: cells of its size would make a pair of all.
        met[n] = nearest.candidates(queries, spark.createDataFrame(rows, POINTS), ["domain"], 10.0, 9, 3, False).count() / 200
    assert met[8000] < 1.5 * met[1000] and met[8000] < 200


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], POINTS), spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0)], POINTS)
    assert nearest.neighbours(none, one, ["domain"], 1.0, 3).collect() == []
    assert nearest.neighbours(one, none, ["domain"], 1.0, 3).collect() == []


def test_a_tree_counts_every_point_once(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame(_clustered(rng, 500, 1, 0) + _clustered(rng, 5, 2, 0), POINTS)
    tree = cells.Tree.of(rows, ["domain"], leaf=4)
    assert tree.placed().count() == 505
    leaves = tree.nodes.where("_leaf")
    assert leaves.agg(F.sum("_n")).first()[0] == 505 and leaves.agg(F.max("_n")).first()[0] <= 4


def test_candidates_are_few_at_any_density(spark):
    # Bounds of cells alone left hundreds of points for each query to be shuffled and ranked.
    rng = random.Random(9)
    rows = [(1, i, *(rng.gauss(0, 1) for _ in range(3)), None if i % 7 == 0 else 1.0) for i in range(3000)]
    known, queries = spark.createDataFrame(rows, POINTS), spark.createDataFrame(rows[:300], POINTS)
    found = nearest.candidates(queries, known, ["domain"], 1.0, 9, 2, True)
    assert found.count() <= 300 * (9 + 8)
    near = nearest.neighbours(queries, known, ["domain"], 1.0, 9)
    assert {(r.domain, r.q_id, r.block_id, r.octant, r["rank"]) for r in near.collect()} == _chosen(rows[:300], rows, 1.0, 9, 2, True)
    assert near.where("v IS NULL").count() == near.where("block_id % 7 = 0").count() > 0


def test_ids_of_any_type(spark):
    rows = [(1, f"b{i % 300:03}" if i else None, float(i % 20), 0.0, 0.0, 0.0) for i in range(300)]
    known = spark.createDataFrame(rows, POINTS.replace("block_id long", "block_id string"))
    found = nearest.neighbours(known.where("block_id IS NULL OR block_id = 'b005'"), known, ["domain"], 0.5, 3)
    assert {(r.q_id, r["rank"]): r.block_id for r in found.collect()} == {(None, 1): None, (None, 2): "b020", (None, 3): "b040", ("b005", 1): "b005", ("b005", 2): "b025", ("b005", 3): "b045"}
