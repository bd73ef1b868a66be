"""k-nearest-neighbour joins at any density: blocks of queries meet the blocks of known points that can hold a neighbour.

Known points and queries are cut into small blocks along a curve (``pair_blocks``). From the boxes and counts of the known blocks, a block of
queries knows how near the neighbours of each of its queries are at the latest, and blocks beyond that are dropped. What is left comes as arrays
to the task of the block of queries, which takes each query's nearest. So no pairs of points are shuffled, and a query meets a
number of points that depends on k, not on the density of points or on the radius. Groups of few known points are not cut: each query
meets them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut, dealt, held
from lodecast.operators.cells import AXES, BOX, finite
from lodecast.operators.pair_blocks import blocks

#: Known points up to which a group is not split, points of a block of queries and of known points, and distances made together.
WHOLE, ASKED, TOLD, TOGETHER = 256, 64, 128, 2**18
_SLACK = 1 + 1e-9


def octant(x: Column, y: Column, z: Column) -> Column:
    """0 to 7: one for a negative x, two for y, four for z; zero is not negative."""
    return (x < 0).cast("int") + 2 * (y < 0).cast("int") + 4 * (z < 0).cast("int")


def _gaps() -> tuple[list[Column], list[Column]]:
    """The least and the greatest coordinate differences, known less query, of both boxes."""
    return [F.col(f"_low{a}") - F.col(f"_q_high{a}") for a in AXES], [F.col(f"_high{a}") - F.col(f"_q_low{a}") for a in AXES]


def nearest_of_boxes() -> Column:
    least, most = _gaps()
    near = [F.greatest(a, -b, F.lit(0.0)) for a, b in zip(least, most, strict=True)]
    return F.sqrt(sum(d * d for d in near))


def _sides() -> Column:
    """Two bits for each axis: whether a difference can be 0 or more, and whether it can be negative."""
    least, most = _gaps()
    return sum((4**i) * ((b >= 0).cast("int") + 2 * (a < 0).cast("int")) for i, (a, b) in enumerate(zip(least, most, strict=True)))


def _octants(sides: int) -> list[int]:
    """The octants that differences of these sides can be in."""
    return [o for o in range(8) if all(sides >> 2 * i & (2 if o >> i & 1 else 1) for i in range(3))]


_MASKS = [sum(2**o for o in _octants(s)) for s in range(64)]
_OWN = [_octants(s)[0] if len(_octants(s)) == 1 else -1 for s in range(64)]


def measured(cells: DataFrame) -> DataFrame:
    """``_near`` and ``_far``, the least and greatest distance between both boxes; ``_own``, the octant in which all of the known box lies
    for all of the query box, or -1; ``_mask``, whose bit o tells that some of it may lie in octant o."""
    least, most = _gaps()
    far = [F.greatest(-a, b) for a, b in zip(least, most, strict=True)]
    own, mask = (F.element_at(F.lit(table), _sides() + 1) for table in (_OWN, _MASKS))
    return cells.withColumns({"_near": nearest_of_boxes(), "_far": F.sqrt(sum(d * d for d in far)), "_own": own, "_mask": mask})


def _limits(met: DataFrame, keys: list[str], radius: float, k: int, least: int, octants: bool) -> DataFrame:
    """``keys, _q, _limits``: for each block of queries how far the ``k`` nearest within the radius, the ``least`` nearest and, with ``octants``, the nearest
    that count of each octant are at the most, by the counts of the blocks of known points."""
    block = [*keys, "_q"]

    def upto(*more: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*block, *more).orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))

    def bound(enough: Column) -> Column:
        return F.min(F.when(enough, F.col("_far"))) * _SLACK

    told = met.select(*block, "_n", "_far", "_own").withColumn("_all", upto())
    bounds = [bound(F.col("_all") >= k)]
    if octants:
        told = told.withColumn("_part", upto("_own"))
        bounds += [bound((F.col("_own") == o) & (F.col("_part") >= of_octant(k))) for o in range(8)]
    fewest = F.coalesce(bound(F.col("_all") >= least), F.lit(float("inf")))
    first, *others = (F.least(b, F.lit(radius)) for b in bounds)
    return told.groupBy(*block).agg(F.array(F.greatest(first, fewest), *others).alias("_limits"))


def _pruned(met: DataFrame, limits: DataFrame, keys: list[str], octants: bool) -> DataFrame:
    """The blocks that can hold one of the nearest."""
    kept = F.col("_near") <= F.element_at("_limits", 1)
    for o in range(8 if octants else 0):
        kept = kept | ((F.col("_near") <= F.element_at("_limits", o + 2)) & (F.col("_mask").bitwiseAND(2**o) != 0))
    return met.join(limits, [*keys, "_q"]).where(kept)


def of_octant(k: int) -> int:
    """How many nearest of each octant come before others."""
    return max(k // 8, 1)


def take(points: np.ndarray, ids: np.ndarray, places: np.ndarray, radius: float, k: int, least: int, octants: bool) -> pd.DataFrame:
    """``q, at, dist, octant``: numbers of queries and known points, axis by axis, that are among each query's max(``k``, ``least``) nearest or, with
    ``octants``, the nearest of an octant within the radius; ties go by ``ids``."""
    out, most, first = [], max(k, least), of_octant(k)
    step = max(1, TOGETHER // len(ids))
    for s in range(0, places.shape[1], step):
        d = [points[i] - places[i, s : s + step, None] for i in range(3)]
        dist = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        octant = (d[0] < 0) + 2 * (d[1] < 0) + 4 * (d[2] < 0)
        kept = dist <= np.partition(dist, most - 1, axis=1)[:, most - 1 : most] if most < len(ids) else np.ones(dist.shape, bool)
        for o in range(8 if octants else 0):
            own = np.where((octant == o) & (dist < radius), dist, np.inf)
            last = np.partition(own, first - 1, axis=1)[:, first - 1 : first] if first < len(ids) else np.inf
            kept |= (own <= last) & (own < np.inf)
        q, at = np.nonzero(kept)
        found = pd.DataFrame({"q": q + s, "at": at, "dist": dist[q, at], "octant": octant[q, at].astype("int32")})
        out.append(found.iloc[np.lexsort((ids[at], found["dist"], q))])
    every = pd.concat(out)
    told = every.groupby("q").cumcount() < most
    if octants:
        told |= (every.groupby(["q", "octant"]).cumcount() < first) & (every["dist"] < radius)
    return every[told]


def candidates(queries: DataFrame, known: DataFrame, keys: list[str], radius: float, k: int, least: int, octants: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys, q_id, block_id, v, carried.., dist, octant``: all known points that can be among each query's neighbours, and few others.

    Among them are the ``k`` nearest within the radius, the ``least`` nearest anywhere and, with ``octants``, the nearest that count of
    each octant. Points without finite coordinates are nobody's neighbours and have none.
    """
    known = finite(known).select(*keys, "block_id", *AXES, "v", *carried)
    queries = finite(queries).select(*keys, F.col("block_id").alias("q_id"), *AXES)
    sizes = held(known.groupBy(*keys).agg(F.count("*").alias("_n")))
    few, many = (sizes.where(c).select(*keys) for c in (f"_n <= {WHOLE}", f"_n > {WHOLE}"))
    found = _paired(_named(queries.join(few, keys)).join(known, keys), carried, keys)
    if many.isEmpty():
        return found
    large = _met(queries.join(many, keys), known.join(many, keys), keys, radius, k, least, octants, carried)
    return large if few.isEmpty() else found.unionByName(large)


def _named(queries: DataFrame) -> DataFrame:
    return queries.withColumnsRenamed({a: f"_q{a}" for a in AXES})


def _paired(pairs: DataFrame, carried: tuple[str, ...], keys: list[str]) -> DataFrame:
    delta = [F.col(a) - F.col(f"_q{a}") for a in AXES]
    return pairs.select(*keys, "q_id", "block_id", "v", *carried, F.sqrt(sum(d * d for d in delta)).alias("dist"), octant(*delta).alias("octant"))


def _met(queries: DataFrame, known: DataFrame, keys: list[str], radius: float, k: int, least: int, octants: bool, carried: tuple[str, ...]) -> DataFrame:
    rows = cut(known.withColumn("_row", F.monotonically_increasing_id()), "known")
    own = cut(queries.withColumn("_own_row", F.monotonically_increasing_id()), "asked")
    number = F.shiftleft(F.col("_id._part").cast("long"), 32) + F.col("_id._block")
    told = blocks(rows.withColumn("_tie", F.struct("block_id")), keys, 0, TOLD, body=("_row", "_tie", *AXES)).withColumn("_t", number).drop("_id")
    asked = blocks(own.withColumn("block_id", F.col("q_id")), keys, 0, ASKED, body=("_own_row", *AXES)).withColumn("_q", number).drop("_id")
    heads = asked.select(*keys, "_q", *(F.col(b).alias(f"_q{b}") for b in BOX)).join(told.select(*keys, "_t", "_n", *BOX), keys)
    met = cut(measured(heads).select(*keys, "_q", "_t", "_n", "_near", "_far", "_own", "_mask"), "met")
    pairs = _pruned(met, _limits(met, keys, radius, k, least, octants), keys, octants).select(*keys, "_q", "_t")
    names = [f"_{a}s" for a in AXES]
    bodies = pairs.join(told.select(*keys, "_t", "__rows", F.col("__ties.block_id").alias("_ids"), *names), [*keys, "_t"]).drop("_t")
    schema = own.select("_own_row").schema.add("_row", "long").add("dist", "double").add("octant", "integer")

    def chosen(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        row = np.concatenate(t["__rows"].to_list())
        order = pd.factorize(np.concatenate(t["_ids"].to_list()), sort=True)[0]
        points, places = np.array([np.concatenate(t[c].to_list()) for c in names]), np.array([q[c].iloc[0] for c in names], float)
        found = take(points, order, places, radius, k, least, octants)
        asked_rows = np.asarray(q["__own_rows"].iloc[0])
        return pd.DataFrame({"_own_row": asked_rows[found["q"]], "_row": row[found["at"]], "dist": found["dist"].to_numpy(), "octant": found["octant"].to_numpy()})

    places = asked.select(*keys, "_q", "__own_rows", *names)
    each = [*keys, "_q"]
    near = dealt(places, each).groupBy(*each).cogroup(dealt(bodies, each).groupBy(*each)).applyInPandas(chosen, schema)
    return near.join(own.select("_own_row", *keys, "q_id"), "_own_row").join(rows.select("_row", "block_id", "v", *carried), "_row").select(*keys, "q_id", "block_id", "v", *carried, "dist", "octant")


def neighbours(queries: DataFrame, known: DataFrame, keys: list[str], radius: float, k: int, least: int = 2, octants: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys, q_id, block_id, v, carried.., dist, octant, rank``: octant-balanced neighbours within a radius.

    Of the known points nearer than ``radius`` (or the ``least`` nearest where fewer
    are), each octant gives up to max(k // 8, 1) nearest, and the nearest others
    fill up to k. Without ``octants``, the k nearest
    count, and a point at the radius itself is within it. Ties go by ``block_id``, which is a key of each group's points.
    """
    query = Window.partitionBy(*keys, "q_id")
    near = query.orderBy("dist", "block_id")
    within = F.col("dist") < radius if octants else F.col("dist") <= radius
    found = candidates(queries, known, keys, radius, k, least, octants, carried)
    ranked = found.withColumns({"_n": F.count_if(within).over(query), "_r": F.row_number().over(near)}).where(F.when(F.col("_n") >= least, within).otherwise(F.col("_r") <= least))
    if octants:
        ranked = ranked.withColumn("_o", F.row_number().over(Window.partitionBy(*keys, "q_id", "octant").orderBy("dist", "block_id")))
        first = F.when(F.col("_o") <= of_octant(k), 0).otherwise(1)
        ranked = ranked.withColumn("_r", F.row_number().over(query.orderBy(first, "dist", "block_id"))).where(F.col("_r") <= k)
        return ranked.withColumn("rank", F.row_number().over(near)).drop("_n", "_r", "_o")
    return ranked.where(F.col("_r") <= k).withColumnRenamed("_r", "rank").drop("_n")
