"""Gaussian process regression: covariance, training on the marginal likelihood, local, global and joint prediction."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.operators import sequential, tiles
from lodecast.operators.blocks import cut, dealt, in_blocks
from lodecast.operators.kriging import predict_each, with_neighbours
from lodecast.operators.spatial import AXES, turned

JITTER = 1e-10
#: Queries that one task predicts together; larger groups are split into such blocks.
BLOCK_ROWS = 4096
# Bounds of amplitude and noise (squares), and of length scales.
SQUARE_BOUNDS, LENGTH_BOUNDS = (1e-5, 1e5), (25.0, 1000.0)


@dataclass(frozen=True)
class Kernel:
    """amplitude * k(distance in length scales) + noise on the diagonal; ``matern32`` or ``rbf``."""

    amplitude: float
    lengths: tuple[float, float, float]
    noise: float
    kind: str = "matern32"

    def isotropic(self) -> Kernel:
        """The kernel with one length scale, the geometric mean of its three."""
        return Kernel(self.amplitude, (math.prod(self.lengths) ** (1 / 3),) * 3, self.noise, self.kind)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = np.zeros((len(a), len(b)))
        for own, other, length in zip(a.T, b.T, self.lengths, strict=True):  # axis by axis, so that no array of all three is held
            d = (own[:, None] - other) / length
            d *= d
            r += d
        return self._of(np.sqrt(r, out=r))

    def at(self, delta: np.ndarray) -> np.ndarray:
        """The covariance at coordinate differences (last axis x, y, z)."""
        d = delta / np.array(self.lengths)
        return self._of(np.sqrt((d * d).sum(-1)))

    def _of(self, r: np.ndarray) -> np.ndarray:
        if self.kind == "matern32":
            return self.amplitude * (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r)
        if self.kind == "rbf":
            return self.amplitude * np.exp(-r * r / 2)
        raise ValueError(f"no kernel {self.kind!r}")

    def factor(self, points: np.ndarray) -> np.ndarray:
        return np.linalg.cholesky(self.between(points, points) + (self.noise + JITTER) * np.eye(len(points)))


def solve_lower(low: np.ndarray, right: np.ndarray, block: int = 256) -> np.ndarray:
    """The solution of ``low`` @ x = ``right`` for a lower triangle, block by block."""
    out = np.array(right, float)
    for i in range(0, len(low), block):
        own = slice(i, i + block)
        out[own] = np.linalg.solve(low[own, own], out[own] - low[own, :i] @ out[:i])
    return out


def inverse_lower(low: np.ndarray, block: int = 256) -> np.ndarray:
    """The inverse of a lower triangle, block by block; what lies above the diagonal is not worked on."""
    out = np.zeros_like(low)
    for i in range(0, len(low), block):
        own = slice(i, i + block)
        out[own, own] = np.linalg.inv(low[own, own])
        out[own, :i] = -out[own, own] @ (low[own, :i] @ out[:i, :i])
    return out


def posterior(points: np.ndarray, values: np.ndarray, places: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Mean and what explains the prior variance (a matrix whose columns' squares sum to it); values are centred by their mean."""
    low, mean = kernel.factor(points), values.mean()
    explained = solve_lower(low, kernel.between(points, places))
    return mean + explained.T @ solve_lower(low, values - mean), explained


def point(points: np.ndarray, values: np.ndarray, place: np.ndarray, kernel: Kernel) -> tuple[float, float]:
    """Mean and variance, noise included, at one place from its neighbours."""
    mean, explained = posterior(points, values, place[None], kernel)
    return float(mean[0]), max(0.0, kernel.amplitude + kernel.noise - float((explained**2).sum()))


def _radii(radius: float | tuple[float, float, float]) -> tuple[float, float, float]:
    return radius if isinstance(radius, tuple) else (radius,) * 3


def ellipsoid_search(delta: np.ndarray, k: int, radii: tuple[float, float, float], angles: tuple[float, float, float], least: int = 2) -> np.ndarray:
    """Row numbers of the known points that ``ellipsoid_neighbours`` takes for one query, nearest first; ``delta`` is known minus query."""
    lag = np.sqrt(sum((c / r) ** 2 for c, r in zip(turned(*delta.T, angles), radii, strict=True)))
    order = np.argsort(lag, kind="stable")[:k]
    return order[(np.arange(len(order)) <= least) | (lag[order] <= 1)]


def infer_local(queries: DataFrame, known: DataFrame, keys: list[str], kernel: Kernel, k: int = 9, radius: float | tuple[float, float, float] = 150.0, angles: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``keys, block_id, estimate, variance`` of each query from its own neighbours and their mean.

    Neighbours are the 3 nearest and up to ``k`` in the ellipsoid of these radii (one for a ball), turned by ``angles``.
    """
    rows = with_neighbours(queries, known, keys, k, _radii(radius), angles)
    return predict_each(rows, keys, lambda p, v, at, _: point(p, v, at, kernel), exact=False)


def infer_global(queries: DataFrame, known: DataFrame, keys: list[str], kernel: Kernel) -> DataFrame:
    """``keys, block_id, estimate, variance`` of each query from all known points of its group.

    The known points of a group must be few enough for a dense factor (some
    thousands, see ``downsample``). Queries are not: they are cut into blocks of
    about BLOCK_ROWS, and each block meets its group's known points.
    """
    asked, told = in_blocks(queries.select(*keys, "block_id", *AXES), known.select(*keys, "block_id", *AXES, "v"), keys, BLOCK_ROWS)
    schema = queries.select(*keys, "block_id").schema.add("estimate", "double").add("variance", "double")

    def predict(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        t = t.sort_values("block_id")
        mean, explained = posterior(t[list(AXES)].to_numpy(float), t.v.to_numpy(float), q[list(AXES)].to_numpy(float), kernel)
        return q[[*keys, "block_id"]].assign(estimate=mean, variance=np.maximum(0, kernel.amplitude + kernel.noise - (explained**2).sum(0)))

    return dealt(asked, [*keys, "_b"]).groupBy(*keys, "_b").cogroup(dealt(told, [*keys, "_b"]).groupBy(*keys, "_b")).applyInPandas(predict, schema)


def simulate_sequential(queries: DataFrame, known: DataFrame, keys: list[str], kernel: Kernel, sims: int, k: int = 9, seed: int = 0, radius: float | tuple[float, float, float] = 150.0, angles: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``keys, sim, block_id, value``: sequential realisations with local prediction at each step, from the neighbours of ``infer_local``."""
    return sequential.simulate(queries, known, keys, kernel, JITTER, sims, seed, sequential.Search(k, _radii(radius), angles))


def simulate_joint(queries: DataFrame, known: DataFrame, keys: list[str], kernel: Kernel, sims: int, seed: int = 0) -> DataFrame:
    """``keys, sim, block_id, value``: draws from the joint posterior of a group's queries.

    Groups of up to ``tiles.TILE`` points and queries are drawn densely, each in a task; of larger ones
    the same factor is made in tiles (``tiles``). The work is cubic in the group either way.
    """
    schema = queries.select(*keys, "block_id").schema.add("sim", "integer").add("value", "double")

    def draw(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        q, t = q.sort_values("block_id"), t.sort_values("block_id")
        places = q[list(AXES)].to_numpy(float)
        mean, explained = posterior(t[list(AXES)].to_numpy(float), t.v.to_numpy(float), places, kernel)
        cov = kernel.between(places, places) + (kernel.noise + 1e-8 * kernel.amplitude) * np.eye(len(q)) - explained.T @ explained
        low = np.linalg.cholesky(cov)
        out = [q[[*keys, "block_id"]].assign(sim=i, value=mean + low @ np.random.default_rng([seed, i]).standard_normal(len(q))) for i in range(sims)]
        return pd.concat(out).astype({"sim": "int32"})

    columns = [*keys, "sim", "block_id", "value"]
    rows = tiles.kinds(queries, known, keys)
    groups, numbers = tiles.large_groups(rows, keys, tiles.TILE)
    small = tiles.of_groups(rows, keys, numbers, "left_anti") if groups else rows
    asked, told = (small.where(f"_asked = {n}").toDF(*small.columns) for n in (1, 0))
    drawn = asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(draw, schema).select(*columns)
    if not groups:
        return drawn
    noises = (kernel.noise + JITTER, kernel.noise + 1e-8 * kernel.amplitude)
    return drawn.unionByName(tiles.simulate(rows, keys, groups, numbers, kernel, noises, sims, seed).select(*columns))


def predict(method: str, queries: DataFrame, known: DataFrame, keys: list[str], kernel: Kernel, sims: int = 128, **options) -> DataFrame:
    """The result of a method by its name: GPR(L), GPR(G), GP-SGS or GP-CRF."""
    if method == "GPR(L)":
        return infer_local(queries, known, keys, kernel, **options)
    if method == "GPR(G)":
        return infer_global(queries, known, keys, kernel, **options)
    if method == "GP-SGS":
        return simulate_sequential(queries, known, keys, kernel, sims, **options)
    if method == "GP-CRF":
        return simulate_joint(queries, known, keys, kernel, sims, **options)
    raise ValueError(f"no method {method!r}")


def _kernel(theta: np.ndarray, kind: str) -> Kernel:
    amplitude, *lengths, noise = np.exp(theta)
    return Kernel(amplitude, tuple(lengths), noise, kind)


def squares(points: np.ndarray) -> np.ndarray:
    """The squared differences of all points along each axis."""
    return np.array([(points[:, None, i] - points[None, :, i]) ** 2 for i in range(3)])


def _correlation(kernel: Kernel, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel without noise, and the part of its slopes that all axes share."""
    r2 = sum(d / length**2 for d, length in zip(apart, kernel.lengths, strict=True))
    if kernel.kind == "rbf":
        k = kernel.amplitude * np.exp(-r2 / 2)
        return k, k
    r = np.sqrt(3 * r2, out=r2)
    decay = kernel.amplitude * np.exp(-r)
    return (1 + r) * decay, 3 * decay


def _value(theta: np.ndarray, values: np.ndarray, kind: str, apart: np.ndarray) -> tuple[float, tuple | None]:
    """Negative log marginal likelihood, and what its gradient is made of; none where there is no factor."""
    kernel, n = _kernel(theta, kind), len(values)
    k, decay = _correlation(kernel, apart)
    try:
        low = np.linalg.cholesky(k + (kernel.noise + JITTER) * np.eye(n))
    except np.linalg.LinAlgError:
        return math.inf, None
    half = solve_lower(low, values)
    return float(half @ half / 2 + np.log(np.diag(low)).sum() + n / 2 * math.log(2 * math.pi)), (kernel, k, decay, low)


def _slopes(made: tuple | None, values: np.ndarray, apart: np.ndarray) -> np.ndarray:
    if made is None:
        return np.zeros(5)
    kernel, k, decay, low = made
    inverse = inverse_lower(low)
    slope = inverse.T @ inverse
    weights = slope @ values
    slope -= np.outer(weights, weights)
    noise = kernel.noise * np.trace(slope)
    amplitude = np.vdot(slope, k)
    slope *= decay
    return np.array([amplitude, *(np.vdot(slope, d) / length**2 for d, length in zip(apart, kernel.lengths, strict=True)), noise]) / 2


def likelihood(theta: np.ndarray, points: np.ndarray, values: np.ndarray, kind: str) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood of centred values and its gradient, at logarithms of the parameters."""
    apart = squares(points)
    value, made = _value(theta, values, kind, apart)
    return value, _slopes(made, values, apart)


_BOUNDS = np.log([SQUARE_BOUNDS, LENGTH_BOUNDS, LENGTH_BOUNDS, LENGTH_BOUNDS, SQUARE_BOUNDS])


def starts(restarts: int, seed: int) -> list[np.ndarray]:
    """Logarithms of the parameters to start from: a fixed one and ``restarts`` at random."""
    rng = np.random.default_rng(seed)
    return [np.log([1, 300, 300, 100, 1]), *(rng.uniform(*_BOUNDS.T) for _ in range(restarts))]


def descended(x: np.ndarray, points: np.ndarray, values: np.ndarray, kind: str, steps: int = 100) -> tuple[float, np.ndarray]:
    """The least negative log likelihood that projected BFGS steps find from one start, and where."""
    bounds, values, apart = _BOUNDS, values - values.mean(), squares(points)
    f, made = _value(x, values, kind, apart)
    g = _slopes(made, values, apart)
    h = np.eye(5) / max(1.0, float(np.abs(g).max()))
    for _ in range(steps):
        free = ~(((x <= bounds[:, 0]) & (g > 0)) | ((x >= bounds[:, 1]) & (g < 0)))
        if np.abs(g[free]).max(initial=0) < 1e-5:
            break
        way = np.where(free, -(h * np.outer(free, free)) @ g, 0)
        if way @ g >= 0:
            way, h = np.where(free, -g, 0), np.eye(5)
        for power in range(30):
            y = np.clip(x + way * 0.5**power, *bounds.T)
            made = None  # so that no two are held
            fy, made = _value(y, values, kind, apart)
            if fy <= f + 1e-4 * g @ (y - x):
                break
        else:
            break
        gy = _slopes(made, values, apart)
        s, u = y - x, gy - g
        if s @ u > 1e-12:
            left = np.eye(5) - np.outer(s, u) / (s @ u)
            h = left @ h @ left.T + np.outer(s, s) / (s @ u)
        done, x, f, g = f - fy < 1e-9 * max(1, abs(f)), y, fy, gy
        if done:
            break
    return f, x


def optimise(points: np.ndarray, values: np.ndarray, kind: str = "matern32", restarts: int = 3, seed: int = 0, steps: int = 100) -> tuple[Kernel, float]:
    """The kernel of least negative log likelihood that projected BFGS steps find from several starts."""
    value, best = min((descended(x, points, values, kind, steps) for x in starts(restarts, seed)), key=lambda found: found[0])
    return _kernel(best, kind), value


def train(known: DataFrame, keys: list[str], kind: str = "matern32", restarts: int = 3, seed: int = 0) -> DataFrame:
    """``keys, n, amplitude, lx, ly, lz, noise, nlml`` of each group; groups are samples of some thousands of points at most.

    Each start of a group is a task of its own, and the best of them counts.
    """
    names = ["n", "amplitude", "lx", "ly", "lz", "noise", "nlml"]
    schema = known.select(*keys).schema.add("_start", "integer").add("n", "long")
    for name in names[1:]:
        schema = schema.add(name, "double")

    begun = starts(restarts, seed)

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("block_id")
        value, theta = descended(begun[t["_start"].iloc[0]], t[list(AXES)].to_numpy(float), t.v.to_numpy(float), kind)
        kernel = _kernel(theta, kind)
        return t[[*keys, "_start"]].head(1).assign(**dict(zip(names, (len(t), kernel.amplitude, *kernel.lengths, kernel.noise, value), strict=True)))

    rows = known.select(*keys, "block_id", *AXES, "v").where("v IS NOT NULL")
    each = cut(rows, "training").withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(restarts))))
    found = dealt(each, [*keys, "_start"]).groupBy(*keys, "_start").applyInPandas(fit, schema)
    best = F.min_by(F.struct(*names), F.struct("nlml", "_start")).alias("_best")
    return found.groupBy(*keys).agg(best).select(*keys, *(f"_best.{name}" for name in names))
