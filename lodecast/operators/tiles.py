"""Joint draws of groups too large for a dense factor in one task: the factor is made tile by tile and lies in files.

Known points and queries of a group, in this order, are cut into blocks of rows. With the lower factor L of their joint covariance,
the values at the queries are the mean, plus L21 times what L11 makes of the known values, plus L22 times normal numbers, just as
from the dense form. A Spark job makes each block column of all groups: a task for each tile, from the tiles left of it, which it reads one
at a time. So a task holds a few tiles, whatever the size of the group, and the files of tiles grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.llm.files import delete_folder, read_file, write_file
from lodecast.operators.blocks import cut, shared_folder
from lodecast.operators.ordered import in_order, running
from lodecast.operators.spatial import AXES

#: Rows of a tile, rows worked on together, and bytes of tiles that the groups worked on at once may fill.
TILE, SLICE, WAVE_BYTES = 2048, 256, 20 * 10**9


def blocks_of(rows: int | Column, tile: int):
    return -(-rows // tile) if isinstance(rows, int) else F.ceil(rows / tile)


@dataclass(frozen=True)
class Group:
    """Counts of a group's known points and queries, and the mean of its values; blocks of known points come first."""

    number: int
    known: int
    asked: int
    mean: float
    tile: int

    @property
    def told(self) -> int:
        return blocks_of(self.known, self.tile)

    @property
    def blocks(self) -> int:
        return self.told + blocks_of(self.asked, self.tile)

    @property
    def size(self) -> int:
        """Bytes of its tiles."""
        return 4 * (self.known + self.asked) * (self.known + self.asked + self.tile)

    def rows(self, i: int) -> tuple[int, int]:
        """The first row of a block, and the one after its last, among the rows of its kind."""
        at, of, n = (i, self.told, self.known) if i < self.told else (i - self.told, self.blocks - self.told, self.asked)
        return -(-at * n // of), -(-(at + 1) * n // of)

    def width(self, i: int) -> int:
        first, last = self.rows(i)
        return last - first


@dataclass(frozen=True)
class Factor:
    """Files of points, tiles and draws; ``kernel`` has ``between``, and ``noises`` are added to the diagonal for known points and queries."""

    place: str
    drawn: str
    kernel: object
    noises: tuple[float, float]
    sims: int
    seed: int

    def _read(self, g: Group, name: str, columns: int) -> np.ndarray:
        return np.frombuffer(read_file(f"{self.place}/{g.number}/{name}")).reshape(-1, columns)

    def _write(self, g: Group, name: str, array: np.ndarray) -> None:
        write_file(f"{self.place}/{g.number}/{name}", np.ascontiguousarray(array).data)

    def tile(self, g: Group, i: int, j: int) -> np.ndarray:
        return self._read(g, f"tile-{i}-{j}", g.width(j))

    def covariance(self, g: Group, i: int, j: int) -> np.ndarray:
        a, b = (self._read(g, f"points-{n}", 4)[:, :3] for n in (i, j))
        out = np.empty((len(a), len(b)))
        for s in range(0, len(a), SLICE):
            out[s : s + SLICE] = self.kernel.between(a[s : s + SLICE], b)
        return out

    def below(self, g: Group, i: int, k: int) -> None:
        """Tile (i, k) below the diagonal."""
        left = self.covariance(g, i, k)
        for j in range(k):
            row, other = self.tile(g, i, j), self.tile(g, k, j)
            for s in range(0, len(row), SLICE):
                left[s : s + SLICE] -= row[s : s + SLICE] @ other.T
        low = self.tile(g, k, k)
        for s in range(0, len(low), SLICE):
            own = slice(s, s + SLICE)
            left[:, own] = np.linalg.solve(low[own, own], (left[:, own] - left[:, :s] @ low[own, :s].T).T).T
        self._write(g, f"tile-{i}-{k}", left)

    def corner(self, g: Group, k: int) -> None:
        """Tile (k, k), and with it what the block's known values come to, or its draws."""
        asked = k >= g.told
        left = self.covariance(g, k, k)
        left[np.diag_indices(len(left))] += self.noises[asked]
        sums = np.zeros((len(left), self.sims if asked else 1))
        for j in range(k):
            row = self.tile(g, k, j)
            for s in range(0, len(row), SLICE):  # what lies above the diagonal is not read
                own, upto = slice(s, s + SLICE), slice(0, s + SLICE)
                left[own, upto] -= row[own] @ row[upto].T
            sums += row @ self._read(g, f"right-{j}", self.sims if j >= g.told else 1)
        low = np.linalg.cholesky(left)
        del left
        self._write(g, f"tile-{k}-{k}", low)
        if asked:
            first, last = g.rows(k)
            right = np.column_stack([np.random.default_rng([self.seed, i]).standard_normal(last)[first:] for i in range(self.sims)])
            write_file(f"{self.drawn}/{g.number}-{k}", np.ascontiguousarray(g.mean + sums + low @ right).data)
        else:
            right = self._read(g, f"points-{k}", 4)[:, 3:] - g.mean - sums
            for s in range(0, len(low), SLICE):
                own = slice(s, s + SLICE)
                right[own] = np.linalg.solve(low[own, own], right[own] - low[own, :s] @ right[:s])
        self._write(g, f"right-{k}", right)

    def draws(self, number: int, block: int) -> np.ndarray:
        return np.frombuffer(read_file(f"{self.drawn}/{number}-{block}")).reshape(-1, self.sims)


def _each(spark: SparkSession, tasks: list[tuple], work) -> None:
    """One Spark task for each call of ``work``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in frame["id"]:
                work(*tasks[n])
            yield frame

    spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(run, "id long").agg(F.count("*")).collect()


def factor(spark: SparkSession, groups: list[Group], made: Factor) -> None:
    """All tiles of these groups, one block column after the other, and the draws at their queries."""

    def work(g: Group, k: int, i: int) -> None:
        if k >= 0:
            made.below(g, i, k)
        if i == k + 1:
            made.corner(g, i)

    for k in range(-1, max(g.blocks for g in groups) - 1):
        # Those that go on to the diagonal have most to do.
        _each(spark, [(g, k, i) for i in range(k + 1, max(g.blocks for g in groups)) for g in groups if i < g.blocks and (k >= 0 or i == 0)], work)


def _waves(groups: list[Group]) -> Iterator[list[Group]]:
    wave: list[Group] = []
    for g in groups:
        if wave and sum(o.size for o in wave) + g.size > WAVE_BYTES:
            yield wave
            wave = []
        wave.append(g)
    yield wave


def kinds(asked: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides as one, with ``_asked``: 0 for known points, 1 for queries."""
    known = told.select(*keys, "block_id", *AXES, F.col("v").cast("double").alias("v"), F.lit(0).alias("_asked"))
    return known.unionByName(asked.select(*keys, "block_id", *AXES, F.lit(None).cast("double").alias("v"), F.lit(1).alias("_asked")))


def large_groups(rows: DataFrame, keys: list[str], tile: int) -> tuple[list[Group], DataFrame]:
    """Groups of ``kinds`` with both sides and more than ``tile`` rows, and a table of their keys (``_k0`` and so on) by number."""
    known = F.col("_asked") == 0
    mean = F.avg(F.when(known, F.coalesce("v", F.lit(float("nan")))))
    sizes = rows.groupBy(*keys).agg(F.count_if(known).alias("_known"), F.count_if(~known).alias("_queries"), mean.alias("_mean"))
    found = sizes.where(f"_known > 0 AND _queries > 0 AND _known + _queries > {tile}").collect()  # each of these is long work, so they are few
    groups = [Group(i, r["_known"], r["_queries"], r["_mean"], tile) for i, r in enumerate(found)]
    schema = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).schema.add("_g", "long")
    return groups, rows.sparkSession.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(found)], schema)


def of_groups(rows: DataFrame, keys: list[str], numbers: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with the table of ``large_groups``; a null key is a key."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(numbers[f"_k{i}"])
    return rows.join(F.broadcast(numbers), same, how)


def simulate(rows: DataFrame, keys: list[str], groups: list[Group], numbers: DataFrame, kernel, noises: tuple[float, float], sims: int, seed: int) -> DataFrame:
    """``keys, block_id, sim, value``: draws at the queries of these groups, from the known points and queries of ``kinds``."""
    spark, tile = rows.sparkSession, groups[0].tile
    made = Factor(shared_folder(spark, "tiles"), shared_folder(spark, "drawn"), kernel, noises, sims, seed)
    own = of_groups(rows, keys, numbers).select("_g", *keys, "block_id", *AXES, "v", "_asked", F.lit(1).alias("_one"))
    ranked = running(in_order(own, ["_g", "_asked", "block_id"]), ["_g", "_asked"], ["block_id"], sums=("_one",))
    told = F.broadcast(spark.createDataFrame([(g.number, g.told) for g in groups], "_g long, _told long"))
    block = F.expr("_one_before") * blocks_of(F.col("_one_all"), tile)
    at = F.floor(block / F.col("_one_all")) + F.col("_asked") * F.col("_told")
    placed = cut(ranked.join(told, "_g").select("_g", at.cast("long").alias("_i"), F.col("_one_before").alias("_r"), *keys, "block_id", *AXES, "v", "_asked"), "placed")

    def store(t: pd.DataFrame) -> pd.DataFrame:
        points = t.sort_values("_r")[[*AXES, "v"]].to_numpy(float)
        write_file(f"{made.place}/{t['_g'].iloc[0]}/points-{t['_i'].iloc[0]}", np.ascontiguousarray(points).data)
        return pd.DataFrame({"n": [len(t)]})

    placed.groupBy("_g", "_i").applyInPandas(store, "n long").agg(F.sum("n")).collect()
    for wave in _waves(groups):
        factor(spark, wave, made)
        for g in wave:
            delete_folder(f"{made.place}/{g.number}")
    schema = rows.select(*keys, "block_id").schema.add("sim", "integer").add("value", "double")

    def told_draws(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_r")
        values = made.draws(int(t["_g"].iloc[0]), int(t["_i"].iloc[0]))
        out = t[[*keys, "block_id"]].loc[t.index.repeat(sims)]
        return out.assign(sim=np.tile(np.arange(sims, dtype="int32"), len(t)), value=values.ravel())

    return placed.where("_asked = 1").groupBy("_g", "_i").applyInPandas(told_draws, schema)
