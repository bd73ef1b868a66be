"""Kriging and sequential Gaussian simulation over neighbours found by a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.operators.blocks import dealt
from lodecast.operators.shapes import bessel_k, rise
from lodecast.operators.spatial import AXES, ellipsoid_neighbours, neighbours, rotation


@dataclass(frozen=True)
class Variogram:
    """A covariance model: effective range, sill (nugget included), nugget and the shape's name.

    At lag 0 the covariance is the sill, beyond it the structured part, sill less
    nugget, times what the shape has left. With ``radii`` and ``angles``, lags are
    taken in turned coordinates over the radii, and the range is 1.
    ``legacy`` gives the covariances of older results instead: no nugget at lag 0,
    a spherical shape whose terms in h are not scaled, and 1 for a Matern at lag 0.
    """

    range: float
    sill: float
    nugget: float = 0.0
    kind: str = "exponential"
    smoothness: float = 1.5
    radii: tuple[float, float, float] | None = None
    angles: tuple[float, float, float] = (0.0, 0.0, 0.0)
    legacy: bool = False

    def covariance(self, lag: np.ndarray) -> np.ndarray:
        h, part = np.asarray(lag, float) / self.range, self.sill - self.nugget
        kind = self.kind.lower()
        if kind not in ("exponential", "gaussian", "spherical", "matern"):
            raise ValueError(f"no covariance model {self.kind!r}")
        if self.legacy and kind == "spherical":
            return np.where(h <= 1, part - 1.5 * h + 0.5 * h**3, self.sill - 1)
        if self.legacy and kind == "gaussian":
            return part * np.exp(-3 * h * h)
        left = part * (1 - rise(h, kind, self.smoothness))
        return (np.where(h > 0, left, 1.0) if kind == "matern" else left) if self.legacy else np.where(h > 0, left, self.sill)

    def lags(self, delta: np.ndarray) -> np.ndarray:
        """Lags of coordinate differences (last axis x, y, z)."""
        if self.radii is not None:
            turn = np.array(rotation(*(math.radians(t) for t in (self.angles[0], self.angles[2], self.angles[1]))), float)
            delta = delta @ turn.T / np.asarray(self.radii, float) * self.range
        return np.sqrt((delta * delta).sum(-1))


def krige_points(points: np.ndarray, values: np.ndarray, places: np.ndarray, model: Variogram, means: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and variances at m places from n neighbours each (m, n, 3), all systems solved together; ordinary kriging without means."""
    m, n = values.shape
    c = model.covariance(model.lags(points - places[:, None]))
    left, right = model.covariance(model.lags(points[:, :, None] - points[:, None])), c
    if means is None:
        left = np.concatenate([np.concatenate([left, np.ones((m, n, 1))], 2), np.concatenate([np.ones((m, 1, n)), np.zeros((m, 1, 1))], 2)], 1)
        right, means = np.concatenate([c, np.ones((m, 1))], 1), values.mean(1)
    # The least squares of smallest norm, as points can coincide.
    w = (np.linalg.pinv(left, rcond=1e-13, hermitian=True) @ right[..., None])[:, :n, 0]
    return means + (w * (values - means[:, None])).sum(1), np.maximum(0.0, model.sill - (w * c).sum(1))


def krige_point(points: np.ndarray, values: np.ndarray, place: np.ndarray, model: Variogram, mean: float | None) -> tuple[float, float]:
    """Estimate and variance at a place; simple kriging with a mean, ordinary kriging without."""
    found = krige_points(points[None], values[None], place[None], model, None if mean is None else np.array([mean]))
    return float(found[0][0]), float(found[1][0])


def octant_search(delta: np.ndarray, k: int, radius: float, least: int = 2) -> np.ndarray:
    """Row numbers of the known points that ``neighbours`` takes for one query, nearest first; ``delta`` is known minus query."""
    lag = np.sqrt((delta * delta).sum(1))
    order = np.flatnonzero(lag < radius)
    if len(order) < least:
        order = np.argsort(lag, kind="stable")[:least]
    order = order[np.argsort(lag[order], kind="stable")]
    octant = (delta[order] < 0) @ np.array([1, 2, 4])
    first = np.zeros(len(order), bool)
    for o in range(8):
        first[np.flatnonzero(octant == o)[: max(k // 8, 1)]] = True
    picked = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])[:k]
    return order[np.sort(picked)]


def with_neighbours(queries: DataFrame, known: DataFrame, keys: list[str], k: int, radius: float | tuple[float, float, float], angles: tuple[float, float, float] | None = None, least: int = 2) -> DataFrame:
    """``keys, q_id, x, y, z, near, group_mean``: each query with its few neighbours as one array.

    With ``angles``, neighbours are those of the turned ellipsoid of these radii; otherwise they are octant-balanced.
    """
    # Places go along, as an ellipsoid's search turns the coordinates.
    places = [f"_at{a}" for a in AXES]
    told = known.withColumns({p: F.col(a) for p, a in zip(places, AXES, strict=True)})
    found = neighbours(queries, told, keys, radius, k, least, carried=tuple(places)) if angles is None else ellipsoid_neighbours(queries, told, keys, radius, angles, least, k, tuple(places))
    own = F.struct("block_id", *(F.col(p).alias(a) for p, a in zip(places, AXES, strict=True)), "v")
    held = found.groupBy(*keys, "q_id").agg(F.sort_array(F.collect_list(own)).alias("near"))
    means = known.groupBy(*keys).agg(F.avg("v").alias("group_mean"))
    return queries.select(*keys, F.col("block_id").alias("q_id"), *AXES).join(held, [*keys, "q_id"]).join(means, keys)


def covariance_column(lag: Column, kind: str, range_: float, sill: float, nugget: float = 0.0) -> Column:
    """The covariance at a lag as a DataFrame expression, for the shapes that need no Bessel function."""
    h, part = lag / range_, sill - nugget
    shapes = {"exponential": F.exp(-3 * h), "gaussian": F.exp(-3 * h * h), "spherical": F.when(h < 1, 1 - 1.5 * h + 0.5 * h * h * h).otherwise(0.0)}
    return F.when(h > 0, part * shapes[kind]).otherwise(sill)


def solved(frame: pd.DataFrame, keys: list[str], point, exact: bool, together: bool) -> pd.DataFrame:
    """``keys, block_id, estimate, variance`` of a batch of queries with their neighbours; those with equally many at once."""
    estimate, variance = np.full(len(frame), np.nan), np.zeros(len(frame))
    sizes = frame.near.map(len).to_numpy()
    places, means = frame[list(AXES)].to_numpy(float), frame.group_mean.to_numpy(float)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        held = np.array([[[p[a] for a in (*AXES, "v")] for p in q] for q in frame.near.iloc[at]], float).reshape(len(at), n, 4)
        points, values = held[..., :3], held[..., 3]
        same = (np.abs(points - places[at][:, None]) <= 1e-8 + 1e-5 * np.abs(places[at][:, None])).all(2)
        known = same.any(1) & exact
        estimate[at[known]] = values[known, same[known].argmax(1)]
        left = np.flatnonzero(~known)
        if together and len(left):
            estimate[at[left]], variance[at[left]] = point(points[left], values[left], places[at[left]], means[at[left]])
        elif len(left):
            for k in left.tolist():
                estimate[at[k]], variance[at[k]] = point(points[k], values[k], places[at[k]], means[at[k]])
    return frame[keys].assign(block_id=frame["q_id"], estimate=estimate, variance=variance)


def predict_each(rows: DataFrame, keys: list[str], point, exact: bool = True, together: bool = False) -> DataFrame:
    """``keys, block_id, estimate, variance``: ``point(points, values, place, mean)`` on each query, in Arrow batches.

    With ``exact``, a query at a known point gets its value and no variance. With
    ``together``, ``point`` takes all queries with equally many neighbours at once.
    """
    schema = rows.select(*keys, F.col("q_id").alias("block_id")).schema.add("estimate", "double").add("variance", "double")
    return rows.mapInPandas(lambda frames: (solved(frame, keys, point, exact, together) for frame in frames), schema)


def predict_scaled(rows: DataFrame, keys: list[str], kind: str, smoothness: float, ordinary: bool = True) -> DataFrame:
    """``keys, block_id, estimate, variance`` where each query brings its group's sill and nugget, and lags are in ranges.

    Queries of the same parameters are solved together, whichever groups they belong to.
    """
    schema = rows.select(*keys, F.col("q_id").alias("block_id")).schema.add("estimate", "double").add("variance", "double")

    def solve(frames):
        for frame in frames:
            for (sill, nugget), own in frame.groupby(["sill", "nugget"], sort=False):
                model = Variogram(1.0, float(sill), float(nugget), kind, smoothness)
                yield solved(own, keys, lambda p, v, at, m, model=model: krige_points(p, v, at, model, None if ordinary else m), True, True)

    return rows.mapInPandas(solve, schema)


def krige(queries: DataFrame, known: DataFrame, keys: list[str], model: Variogram, k: int = 9, radius: float | None = None, ordinary: bool = True) -> DataFrame:
    """``keys, block_id, estimate, variance`` for each query with a known point in its group.

    Neighbours are found by a join; each query's few neighbours are then one row,
    so the equations are solved in Arrow batches of queries, without a shuffle of
    their own. A query at a known point gets its value and no variance. The mean of
    simple kriging is that of the group's known values.
    """
    rows = with_neighbours(queries, known, keys, k, radius or model.range / 2)
    return predict_each(rows, keys, lambda points, values, places, means: krige_points(points, values, places, model, None if ordinary else means), together=True)


def simulate(queries: DataFrame, known: DataFrame, keys: list[str], model: Variogram, sims: int, k: int = 9, seed: int = 0, ordinary: bool = True, point=None, radius: float | None = None, search=None) -> DataFrame:
    """``keys, sim, block_id, value``: sequential Gaussian realisations.

    A realisation visits the queries in a random order, draws each from its kriged
    distribution and adds it to the known points; it is sequential by definition,
    so groups and realisations are what runs in parallel. Each step takes the neighbours
    that ``krige`` would: octant-balanced within the radius. ``point`` and ``search``, if
    given, are used in place of kriging and of that search.
    """
    search = search or (lambda delta: octant_search(delta, k, radius or model.range / 2))
    told = known.where(F.abs("v") < float("inf"))  # a known point without a value is neither known nor asked for
    both = told.select(*keys, "block_id", *AXES, "v").unionByName(queries.select(*keys, "block_id", *AXES, F.lit(None).cast("double").alias("v")))
    spread = both.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    schema = spread.select(*keys, "sim", "block_id").schema.add("value", "double")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block_id")
        fixed, open_ = frame[frame.v.notna()], frame[frame.v.isna()]
        rng = np.random.default_rng([seed, int(frame.sim.iloc[0])])
        places = np.concatenate([fixed[list(AXES)].to_numpy(float), np.zeros((len(open_), 3))])
        values = np.concatenate([fixed.v.to_numpy(float), np.zeros(len(open_))])
        n, mean = len(fixed), float(fixed.v.mean()) if len(fixed) else 0.0
        at, out = open_[list(AXES)].to_numpy(float), np.zeros(len(open_))
        for i in rng.permutation(len(open_)):
            near = search(places[:n] - at[i])
            if n == 0:
                out[i] = rng.normal(mean, math.sqrt(model.sill))
            elif (np.abs(places[near[0]] - at[i]) <= 1e-8 + 1e-5 * np.abs(at[i])).all():
                out[i] = values[near[0]]
            else:
                args = places[near], values[near], at[i]
                m, var = point(*args, mean) if point else krige_point(*args, model, None if ordinary else mean)
                out[i] = rng.normal(m, math.sqrt(abs(var)))
            places[n], values[n] = at[i], out[i]
            n += 1
        return open_[[*keys, "sim", "block_id"]].assign(value=out)

    return dealt(spread, [*keys, "sim"]).groupBy(*keys, "sim").applyInPandas(run, schema)
