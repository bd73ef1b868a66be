"""Spatial projections, neighbour joins, grids and experimental variograms."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators import pair_blocks
from lodecast.operators.nearest import AXES, neighbours, octant

__all__ = ["AXES", "neighbours", "octant"]


def domain_key(domain: str = "domain_id") -> Column:
    """The name LZ{l}_{g}_{p}_{r} of a four-digit domain id."""
    d = F.col(domain)
    return F.format_string("LZ%d_%d_%d_%d", F.floor(d / 1000), F.floor(d / 100) % 10, F.floor(d / 10) % 10, d % 10)


#: A rotation as a product of three matrices in the order written; x, y, z counter-clockwise, capitals their transposes.
PLUNGE_ABOUT_X, DIP_ABOUT_X = "yXz", "xyZ"


def rotation(azimuth, about_x, about_y, sequence: str = DIP_ABOUT_X) -> list[list]:
    """The three by three matrix of a rotation, of columns or numbers; azimuth turns about z. Angles are in radians.

    ``sequence`` names three factors, such as "xyZ" for Rx Ry Rz transposed.
    """
    math_ = F if isinstance(azimuth, Column) else math

    def one(axis: str, angle) -> list[list]:
        c, s = math_.cos(angle), math_.sin(angle)
        return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]

    out = None
    for name in sequence:
        m = one(name.lower(), {"x": about_x, "y": about_y, "z": azimuth}[name.lower()])
        m = [list(r) for r in zip(*m, strict=True)] if name.isupper() else m
        out = m if out is None else [[sum((out[i][k] * m[k][j] for k in range(3) if not (_zero(out[i][k]) or _zero(m[k][j]))), 0) for j in range(3)] for i in range(3)]
    return out


def _zero(x) -> bool:
    return isinstance(x, int) and x == 0


def rotated(rows: DataFrame, plunge_about_x: bool = False, sequence: str | None = None, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), rotate: bool = True, scale: bool = True, relative: bool = True) -> DataFrame:
    """``rx, ry, rz``: coordinates from the origin, turned by angle1..3 (azimuth, plunge, dip in degrees) and divided by search1x..z.

    Dip turns about x and plunge about y, in the order Rx Ry Rz transposed; with
    ``plunge_about_x`` it is the other way round and the order Ry Rx-transposed Rz.
    ``sequence`` gives another order. Radii are relative to the largest one, or as they are.
    """
    a, plunge, dip = (F.radians(F.col(n)) for n in ("angle1", "angle2", "angle3"))
    about_x, about_y = (plunge, dip) if plunge_about_x else (dip, plunge)
    matrix = rotation(a, about_x, about_y, sequence or (PLUNGE_ABOUT_X if plunge_about_x else DIP_ABOUT_X)) if rotate else [[int(i == j) for j in range(3)] for i in range(3)]
    delta = [F.col(c) - o for c, o in zip(AXES, origin, strict=True)]
    most = F.greatest("search1x", "search1y", "search1z") if relative else F.lit(1.0)
    radii = [F.col(f"search1{c}") / most if scale else F.lit(1.0) for c in AXES]
    return rows.withColumns({f"r{c}": sum((delta[k] * m for k, m in enumerate(r) if not _zero(m)), F.lit(0.0)) / radius for c, r, radius in zip(AXES, matrix, radii, strict=True)})


def with_geometry(rows: DataFrame, geometry: DataFrame, key: str = "domain_id", angle: float = 0.0, radius: float = 300.0) -> DataFrame:
    """``rows`` with the angles and radii of their domain; a domain without an entry is not turned and has one radius."""
    other = geometry.select(key, *(f"angle{i}" for i in (1, 2, 3)), *(f"search1{a}" for a in AXES))
    joined = rows.join(other, key, "left")
    return joined.fillna(angle, [f"angle{i}" for i in (1, 2, 3)]).fillna(radius, [f"search1{a}" for a in AXES])


def clipped_at_least(samples: DataFrame, blocks: DataFrame, keys: list[str], margin: float, least: int) -> DataFrame:
    """Like ``clipped``, but groups with fewer than ``least`` samples inside keep the ``least`` nearest to the box's centre.

    Nearest by the largest coordinate difference; ties go by ``block_id``.
    """
    bounds = blocks.groupBy(*keys).agg(*(f(a).alias(f"_{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))))
    inside = " AND ".join(f"{a} > _low_{a} - {margin} AND {a} < _high_{a} + {margin}" for a in AXES)
    placed = samples.join(bounds, keys).withColumn("_in", F.expr(inside))
    short = placed.groupBy(*keys).agg(F.count_if("_in").alias("_n")).where(F.col("_n") < least)
    whole = placed.where("_in").join(short, keys, "left_anti")
    off = F.greatest(*(F.abs(F.col(a) - (F.col(f"_low_{a}") + F.col(f"_high_{a}")) / 2) for a in AXES))
    # The nearest of each part first, so that a group is not ordered in one task.
    parted = placed.join(short, keys, "left_semi").select(*samples.columns, off.alias("_off"), F.pmod(F.xxhash64("block_id"), F.lit(64)).alias("_part"))
    for group in ([*keys, "_part"], keys):
        parted = parted.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_off", "block_id"))).where(F.col("_r") <= least)
    return whole.select(*samples.columns).unionByName(parted.select(*samples.columns))


def clipped(samples: DataFrame, blocks: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """Samples strictly inside the box of their group's blocks, widened by a margin."""
    bounds = blocks.groupBy(*keys).agg(*(f(a).alias(f"_{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))))
    inside = " AND ".join(f"{a} > _low_{a} - {margin} AND {a} < _high_{a} + {margin}" for a in AXES)
    return samples.join(bounds, keys).where(inside).select(*samples.columns)


def turned(x, y, z, angles: tuple[float, float, float]) -> tuple:
    """Coordinates, as columns or arrays, turned by azimuth, plunge and dip (degrees) as in ``rotated``."""
    azimuth, plunge, dip = map(math.radians, angles)
    return tuple(sum(m * c for m, c in zip(r, (x, y, z), strict=True)) for r in rotation(azimuth, dip, plunge))


def in_ellipsoid(rows: DataFrame, radii: tuple[float, float, float], angles: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """``rows`` with turned coordinates over the radii in place of their own: an ellipsoid becomes the unit ball."""
    places = turned(*(F.col(a) for a in AXES), angles)
    return rows.withColumns({a: c / r for a, c, r in zip(AXES, places, radii, strict=True)})


def ellipsoid_neighbours(queries: DataFrame, known: DataFrame, keys: list[str], radii: tuple[float, float, float], angles: tuple[float, float, float] = (0.0, 0.0, 0.0), least: int = 2, most: int = 9, carried: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``neighbours``; ``dist`` is in radii. The ``least`` + 1 nearest known points, wherever they are, and others in the ellipsoid up to ``most``."""
    return neighbours(in_ellipsoid(queries, radii, angles), in_ellipsoid(known, radii, angles), keys, 1.0, most, min(least + 1, most), octants=False, carried=carried)


def octant_neighbours_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of neighbours already ranked by distance, up to max(k // 8, 1) of each octant and the nearest others up to k."""
    query = Window.partitionBy(*keys, "q_id")
    ranked = found.drop("rank").withColumn("_o", F.row_number().over(Window.partitionBy(*keys, "q_id", "octant").orderBy("dist", "block_id")))
    first = F.when(F.col("_o") <= max(k // 8, 1), 0).otherwise(1)
    chosen = ranked.withColumn("_r", F.row_number().over(query.orderBy(first, "dist", "block_id"))).where(F.col("_r") <= k)
    return chosen.withColumn("rank", F.row_number().over(query.orderBy("dist", "block_id"))).drop("_o", "_r")


def ellipsoid_octant_neighbours(queries: DataFrame, known: DataFrame, keys: list[str], radii: tuple[float, float, float], angles: tuple[float, float, float] = (0.0, 0.0, 0.0), least: int = 2, most: int = 9) -> DataFrame:
    """Columns of ``neighbours``: of the 8 * ``most`` nearest in the ellipsoid (the ``least`` + 1 nearest wherever they are), a balanced choice of octants."""
    return octant_neighbours_of(ellipsoid_neighbours(queries, known, keys, radii, angles, least, 8 * most), keys, most)


def neighbourhood_mean(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, q_id, n, mean`` of the finite values of each query's neighbours."""
    v = F.when(F.abs("v") < float("inf"), F.col("v"))
    return found.groupBy(*keys, "q_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"))


def same_points(queries: DataFrame, known: DataFrame, keys: list[str], absolute: float = 1e-8, share: float = 1e-5) -> DataFrame:
    """``keys, q_id, block_id, v``: for each query the first known point (by id) whose coordinates all lie within absolute + share * abs(query).

    Points meet through cells no smaller than the widest tolerance of the data.
    """
    most = queries.agg(*(F.max(F.abs(a)).alias(a) for a in AXES)).first()
    size = max(absolute + share * max((v or 0.0) for v in most), 1e-12)
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"_c{a}") for a in AXES]
    near = F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(AXES, s, strict=True))) for s in product((-1, 0, 1), repeat=3)))).alias("_s")
    q = queries.select(*keys, F.col("block_id").alias("q_id"), *(F.col(a).alias(f"q{a}") for a in AXES), *cells, near)
    q = q.select(*keys, "q_id", *(f"q{a}" for a in AXES), *((F.col(f"_c{a}") + F.col(f"_s.d{a}")).alias(f"_c{a}") for a in AXES))
    close = " AND ".join(f"abs({a} - q{a}) <= {absolute} + {share} * abs(q{a})" for a in AXES)
    met = q.join(known.select(*keys, "block_id", *AXES, "v", *cells), [*keys, *(f"_c{a}" for a in AXES)]).where(close)
    return met.groupBy(*keys, "q_id").agg(F.min(F.struct("block_id", "v")).alias("_m")).select(*keys, "q_id", "_m.block_id", "_m.v")


def combined(samples: DataFrame, others: DataFrame) -> DataFrame:
    """Both sources as one, the second first in the order of ``source``: its points are 0, those of ``samples`` 1."""
    return others.withColumn("source", F.lit(0)).unionByName(samples.withColumn("source", F.lit(1)))


def grid_means(rows: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``keys, ix, iy, iz, n, total, mean`` of the values in each cell; cells are counted from the group's least corner."""
    low = rows.groupBy(*keys).agg(*(F.min(a).alias(f"_low_{a}") for a in AXES))
    at = [F.rint((F.col(a) - F.col(f"_low_{a}")) / size).cast("long").alias(f"i{a}") for a in AXES]
    return rows.join(low, keys).select(*keys, *at, "v").groupBy(*keys, *(f"i{a}" for a in AXES)).agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))


#: Points up to which a group's pairs are made together.
EVERY_PAIR = 4096


def variogram(rows: DataFrame, keys: list[str], max_lag: float, lags: int, every_pair: int = EVERY_PAIR) -> DataFrame:
    """``keys, lag, n, gamma``: half the mean squared difference of pairs in each distance bin up to ``max_lag``.

    Groups of up to ``every_pair`` points are one block; those of more are cut into blocks, and each pair of blocks
    within the lag is met once. Both give the same rows. Missing, NaN and infinite values have no pairs.
    """
    return pair_blocks.variogram(rows.where(F.abs("v") < float("inf")), keys, max_lag, lags, every_pair)


def mean_variogram(rows: DataFrame, keys: list[str], max_lag: float, lags: int, value: str = "value", first: int = 16) -> DataFrame:
    """``keys, lag, gamma``: the mean of the variograms of the first realisations, each taken alone."""
    each = variogram(rows.where(F.col("sim") < first).withColumn("v", F.col(value)), [*keys, "sim"], max_lag, lags)
    return each.groupBy(*keys, "lag").agg(F.avg("gamma").alias("gamma"))


def variogram_ratios(curves: DataFrame, keys: list[str], reference: str, model: str = "model") -> DataFrame:
    """``keys, model, p25, p50, p75, fidelity`` of each model's variogram over the reference's.

    Only lags that all models of the group have count. Fidelity is
    sqrt(1 - abs(min(p50, 2) - 1)), one for equal curves.
    """
    models = curves.groupBy(*keys).agg(F.count_distinct(model).alias("_all"))
    whole = curves.groupBy(*keys, "lag").agg(F.count_distinct(model).alias("_has")).join(models, keys).where("_has = _all").select(*keys, "lag")
    base = curves.where(F.col(model) == reference).select(*keys, "lag", F.col("gamma").alias("_base")).where("_base > 0").join(whole, [*keys, "lag"])
    ratio = curves.join(base, [*keys, "lag"]).withColumn("_r", F.col("gamma") / F.col("_base"))
    cut = ratio.groupBy(*keys, model).agg(*(F.expr(f"percentile(_r, {p / 100!r})").alias(f"p{p}") for p in (25, 50, 75)))
    return cut.withColumn("fidelity", F.sqrt(1 - F.abs(F.least("p50", F.lit(2.0)) - 1)))


def grid(rows: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``keys, x, y, z``: a regular grid from each group's least corner, as far as its box reaches."""
    box = rows.groupBy(*keys).agg(*(f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))))
    for a in AXES:
        steps = F.floor((F.col(f"_high{a}") - F.col(f"_low{a}")) / size).cast("long")
        box = box.withColumn(f"_i{a}", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
    return box.select(*keys, *((F.col(f"_low{a}") + F.col(f"_i{a}") * size).alias(a) for a in AXES))
