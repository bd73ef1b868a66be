"""Cells of points that are split by count, for joins and sums that open only the cells they must."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut, held

AXES = ("x", "y", "z")
#: Points above which a cell is split, halvings of the box at most, the level to start at, and halvings from one level to the next.
LEAF, LEVELS, START, STEP = 32, 20, 2, 2
#: Levels that are counted in one pass over the points.
PASS = 3
CELL = [f"_c{a}" for a in AXES]
BOX = [f"_{n}{a}" for a in AXES for n in ("low", "high")]


def finite(rows: DataFrame) -> DataFrame:
    """Rows whose coordinates are neither null nor NaN nor infinite."""
    return rows.where(" AND ".join(f"abs({a}) < double('infinity')" for a in AXES))


def cubes_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _low.., _size``: the least corner and the edge of the cube around each group; no edge where all points are one."""
    size = F.greatest(*(F.max(a) - F.min(a) for a in AXES))
    return held(rows.groupBy(*keys).agg(*(F.min(a).alias(f"_low{a}") for a in AXES), F.nullif(size, F.lit(0.0)).alias("_size")))


def with_cells(rows: DataFrame, cubes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the numbers of their finest cells."""
    most = 2**LEVELS
    at = {f"_c{a}": F.coalesce(F.least(F.floor((F.col(a) - F.col(f"_low{a}")) / F.col("_size") * most), F.lit(most - 1)), F.lit(0)).cast("int") for a in AXES}
    return rows.join(cubes, keys).withColumns(at).select(*rows.columns, *CELL)


@dataclass
class Tree:
    """Points with their finest cell, the cubes around each group, and the cells of all levels as rows: ``keys, _l, CELL, _n, BOX, _leaf`` and sums.

    Level by level a cell's box is halved on each axis; only cells with more than ``leaf`` points, not all at one place, have
    cells below them. Boxes are those of the points inside. Of each level only counts are shuffled.
    """

    keys: list[str]
    cubes: DataFrame
    points: DataFrame
    nodes: DataFrame
    depths: list[int]
    crowded: bool
    leaf: int
    step: int = STEP

    @classmethod
    def of(cls, rows: DataFrame, keys: list[str], leaf: int = LEAF, sums: dict | None = None, cubes: DataFrame | None = None, *, step: int = STEP) -> Tree:
        """The tree of finite points; ``sums`` are aggregates more for each cell, by their names, ``cubes`` are of more points than these, ``step`` the halvings from level to level."""
        edges = [f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
        cubes = cubes_of(rows, keys) if cubes is None else cubes
        points = with_cells(rows, cubes, keys)
        flat = " AND ".join(f"_low{a} = _high{a}" for a in AXES)
        found, level = None, START
        while True:
            levels = [n for n in range(level, level + PASS * step, step) if n <= LEVELS]
            told = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels))))
            told = told.withColumns({c: F.expr(f"shiftright({c}, {LEVELS} - _l)") for c in CELL})
            more = told.groupBy(*keys, "_l", *CELL).agg(F.count("*").alias("_n"), *edges, *(f.alias(n) for n, f in (sums or {}).items()))
            more = more.withColumn("_leaf", F.expr(f"_n <= {leaf} OR ({flat}) OR _l + {step} > {LEVELS}"))
            found = cut(more if found is None else found.unionByName(more), "cells")
            # A cell is one if the cell above it is split; all above that are too, as they hold more.
            up = found.where("NOT _leaf").select(*keys, (F.col("_l") + step).alias("_l"), *(F.col(c).alias(f"_up{c}") for c in CELL))
            below = found.withColumns({f"_up{c}": F.shiftright(c, step) for c in CELL}).join(up, [*keys, "_l", *(f"_up{c}" for c in CELL)], "left_semi").drop(*(f"_up{c}" for c in CELL))
            nodes = found.where(F.col("_l") == START).unionByName(below.select(found.columns))
            seen = nodes.groupBy("_l").agg(F.bool_and("_leaf").alias("done"), F.bool_or(F.expr(f"_leaf AND _n > {leaf}")).alias("crowded")).collect()  # a row for each level
            last = max((r["_l"] for r in seen), default=START)
            if all(r["done"] for r in seen if r["_l"] == last) or last < levels[-1]:
                return cls(keys, cubes, points, nodes, list(range(START, last + 1, step)), any(r["crowded"] for r in seen), leaf, step)
            level = levels[-1] + step

    def placed(self, first: int | None = None) -> DataFrame:
        """The points with ``_l`` and ``CELL`` of their leaf; with ``first``, so many by ``block_id`` of equal points that overfill one."""
        told = self.points.withColumn("_l", F.explode(F.array(*map(F.lit, self.depths)))).withColumns({c: F.expr(f"shiftright({c}, {LEVELS} - _l)") for c in CELL})
        place = [*self.keys, "_l", *CELL]
        rows = told.join(self.nodes.where("_leaf").select(*place), place)
        if first is None or not self.crowded:
            return rows
        same = [*place, *AXES]
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("block_id"), F.lit(64)))
        for group in ([*same, "_part"], same):  # the first of each part first, so that equal points are not ordered in one task
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("block_id"))).where(F.col("_r") <= first)
        return rows.drop("_part", "_r")

    def located(self, others: DataFrame) -> DataFrame:
        """Other points with ``_l`` and ``CELL`` of the leaf they lie in, or of the empty cell beside leaves; the cubes must hold them.

        So a cell of others is no larger than what few of the tree's points fill.
        """
        place = [*self.keys, "_l", *CELL]
        told = with_cells(others, self.cubes, self.keys).withColumn("_l", F.explode(F.array(*map(F.lit, self.depths)))).withColumns({c: F.expr(f"shiftright({c}, {LEVELS} - _l)") for c in CELL})
        split = self.nodes.where("NOT _leaf").select(*place)
        up = split.select(*self.keys, (F.col("_l") + self.step).alias("_l"), *(F.col(c).alias(f"_up{c}") for c in CELL))
        last = told.join(split, place, "left_anti").withColumns({f"_up{c}": F.shiftright(c, self.step) for c in CELL})
        first = last.where(F.col("_l") == START)
        below = last.where(F.col("_l") > START).join(up, [*self.keys, "_l", *(f"_up{c}" for c in CELL)], "left_semi")
        return first.unionByName(below.select(first.columns)).drop(*(f"_up{c}" for c in CELL))
