"""Moments of pairs by distance from pairs of cells: only cells that lie across a lag's edge are opened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut
from lodecast.operators.cells import AXES, BOX, CELL, START, Tree, finite

#: Places above which a cell is split, and halvings from one level to the next.
LEAF, STEP = 8, 1
MOMENTS = ["_w", "_s", "_q"]
_SIDE = ["_l", *CELL, *BOX, *MOMENTS, "_leaf"]


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def _lag(d: Column, max_lag: float, lags: int) -> Column:
    return F.floor(d * lags / max_lag).cast("long")


def _between(a: str, b: str) -> tuple[Column, Column]:
    """Pairs and half the squared differences of all pairs of two sides that share no point."""
    w, s, q = ([F.col(f"{side}.{m}") for side in (a, b)] for m in MOMENTS)
    return w[0] * w[1], F.greatest((w[1] * q[0] + w[0] * q[1] - 2 * s[0] * s[1]) / 2, F.lit(0.0))


def _within(a: str) -> tuple[Column, Column]:
    """Pairs and half the squared differences of the pairs of one side."""
    w, s, q = (F.col(f"{a}.{m}") for m in MOMENTS)
    return F.expr(f"{a}._w * ({a}._w - 1) div 2"), F.greatest((w * q - s * s) / 2, F.lit(0.0))


def _summed(pairs: DataFrame, keys: list[str], own: Column, lag: Column) -> DataFrame:
    (n, g), (n_own, g_own) = _between("a", "b"), _within("a")
    found = pairs.select(*keys, lag.alias("lag"), F.when(own, n_own).otherwise(n).alias("_n"), F.when(own, g_own).otherwise(g).alias("_g"))
    return found.where("_n > 0").groupBy(*keys, "lag").agg(F.sum("_n").alias("_n"), F.sum("_g").alias("_g"))


def _judged(pairs: DataFrame, max_lag: float, lags: int) -> DataFrame:
    """Pairs of cells that can hold a pair within ``max_lag``, with the lag of all their pairs where it is one.

    Distances of boxes are made as those of points are, and each step of that rounds alike, so they bound those of the points inside.
    """
    apart = [F.greatest(F.col(f"b._low{a}") - F.col(f"a._high{a}"), F.col(f"a._low{a}") - F.col(f"b._high{a}"), F.lit(0.0)) for a in AXES]
    across = [F.greatest(F.col(f"b._high{a}") - F.col(f"a._low{a}"), F.col(f"a._high{a}") - F.col(f"b._low{a}")) for a in AXES]
    low, high = _length(apart), _length(across)
    one = F.when((_lag(low, max_lag, lags) == _lag(high, max_lag, lags)) & (high < max_lag), _lag(low, max_lag, lags))
    return pairs.where(low < max_lag).withColumn("_one", one)


def _opened(pairs: DataFrame, nodes: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Pairs of the cells below: a side that is split gives way to its parts at ``level``, a leaf stays."""
    parts = nodes.where(F.col("_l") == level).select(*keys, *(F.shiftright(c, STEP).alias(f"_up{c}") for c in CELL), F.struct(*_SIDE).alias("_part"))
    for side in ("a", "b"):
        split = pairs.where(f"NOT {side}._leaf").withColumns({f"_up{c}": F.col(f"{side}.{c}") for c in CELL})
        below = split.join(parts, [*keys, *(f"_up{c}" for c in CELL)]).withColumn(side, F.col("_part"))
        pairs = pairs.where(f"{side}._leaf").unionByName(below.select(*pairs.columns))
    corner = [F.struct(*(F.col(f"{s}.{c}") for c in CELL)) for s in ("a", "b")]
    # Of a cell's pairs with itself, each pair of its parts once.
    return pairs.where(~F.col("own") | (corner[0] <= corner[1])).withColumn("own", F.col("own") & (corner[0] == corner[1]))


def settled(rows: DataFrame, keys: list[str], max_lag: float, lags: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pairs of cells settle, ``keys, lag, _n, _g``; the pairs of leaves that are left, ``keys, a, b, own``; and the places by leaf.

    Points at one place are one place with a count, a sum and a sum of squares. Pairs of cells begin at a coarse level; those
    too far apart fall out, those whose least and greatest distance have one lag are summed from the moments of both, and
    the rest are opened, level by level, until both are leaves. No task holds a group, and a leaf has few places (more only where
    they lie closer together than 2 ** -20 of the group's span).
    """
    middle = rows.groupBy(*keys).agg(F.avg("v").alias("_mean"))
    v = F.col("v") - F.col("_mean")  # so that squares stay small beside the differences
    places = cut(finite(rows).join(middle, keys).groupBy(*keys, *AXES).agg(F.count("*").alias("_w"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q")), "places")
    tree = Tree.of(places, keys, leaf, {m: F.sum(m) for m in MOMENTS}, step=STEP)
    nodes = cut(tree.nodes.select(*keys, *_SIDE), "nodes")
    first = nodes.where(F.col("_l") == START)
    sides = [first.select(*keys, F.struct(*_SIDE).alias(s)) for s in ("a", "b")]
    corner = [F.struct(*(F.col(f"{s}.{c}") for c in CELL)) for s in ("a", "b")]
    pairs = sides[0].join(sides[1], keys).where(corner[0] <= corner[1]).withColumn("own", corner[0] == corner[1])  # at most 64 cells of a group
    sums, left = [], []
    for level in tree.depths:
        judged = cut(_judged(pairs, max_lag, lags), "pairs")
        sums.append(_summed(judged.where("_one IS NOT NULL"), keys, F.col("own"), F.col("_one")))
        across = judged.where("_one IS NULL").drop("_one")
        left.append(across.where("a._leaf AND b._leaf"))
        pairs = _opened(across.where("NOT (a._leaf AND b._leaf)"), nodes, keys, level + STEP)
    total = reduce(DataFrame.unionByName, sums)
    return total, reduce(DataFrame.unionByName, left), tree.placed()


def pair_moments(rows: DataFrame, keys: list[str], max_lag: float, lags: int, leaf: int = LEAF) -> DataFrame:
    """``keys, lag, n, gamma`` of all pairs nearer than ``max_lag``, as from every pair; ``v`` must be finite, points without finite places have no pairs."""
    sums, left, places = settled(rows, keys, max_lag, lags, leaf)
    place = [*keys, "_l", *CELL]
    point = F.struct(*AXES, *MOMENTS)
    cells = left.select(*keys, "own", *(F.col(f"{s}.{c}").alias(f"_{s}{c}") for s in ("a", "b") for c in ("_l", *CELL)))
    for s in ("a", "b"):
        side = places.select(*(F.col(c).alias(c if c in keys else f"_{s}{c}") for c in place), point.alias(s))
        cells = cells.join(side, [*keys, *(f"_{s}{c}" for c in ("_l", *CELL))]).drop(*(f"_{s}{c}" for c in ("_l", *CELL)))
    at = [F.struct(*(F.col(f"{s}.{a}") for a in AXES)) for s in ("a", "b")]
    met = cells.where(~F.col("own") | (at[0] <= at[1]))
    dist = _length([F.col(f"b.{a}") - F.col(f"a.{a}") for a in AXES])
    met = met.withColumn("_d", dist).where(F.col("_d") < max_lag)
    points = _summed(met, keys, F.col("own") & (at[0] == at[1]), _lag(F.col("_d"), max_lag, lags))
    return sums.unionByName(points).groupBy(*keys, "lag").agg(F.sum("_n").alias("n"), (F.sum("_g") / F.sum("_n")).alias("gamma"))
