"""Sums over all pairs of points by distance, from blocks of points that lie together.

Pairs are quadratic in a group's points within the lag. What Spark shuffles is blocks: a block goes once to each block that it can
have a near pair with, so rows shuffled are the points times the blocks near them, and no task holds more than a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut, held
from lodecast.operators.cells import AXES, BOX, CELL, LEVELS, finite, with_cells

#: Points of a block, and those that meet another block together.
BLOCK, TILE = 2048, 128
#: Rows of a part of the curve, at least about.
PART_ROWS = 4 * BLOCK
#: Pairs that a task makes, and pairs of blocks that it reads.
TASK_PAIRS, TASK_BLOCKS = 64_000_000, 2000
_BODY = [*(f"_{a}s" for a in AXES), "_vs"]


def curve() -> Column:
    """A place on a curve through all finest cells: the bits of their numbers, interleaved."""

    def spaced(c: Column) -> Column:
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    assert LEVELS <= 21
    return reduce(Column.bitwiseOR, (F.shiftleft(spaced(F.col(c).cast("long")), i) for i, c in enumerate(CELL)))


def blocks(rows: DataFrame, keys: list[str], whole: int, size: int = BLOCK, *, body: tuple[str, ...] = (*AXES, "v")) -> DataFrame:
    """``keys, _id, _n, BOX, _xs, _ys, _zs, _vs``: the points of groups of up to ``whole`` as one block, those of others in blocks of up to ``size``.

    ``body`` names other columns, without nulls, to be taken as lists.

    Points follow a curve through the group's cube, in an order over all tasks, so that a block's box is small.
    """
    span = F.greatest(*(F.max(a) - F.min(a) for a in AXES))
    groups = held(rows.groupBy(*keys).agg(F.count("*").alias("_all"), *(F.min(a).alias(f"_low{a}") for a in AXES), F.nullif(span, F.lit(0.0)).alias("_size")))
    total = groups.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    placed = with_cells(rows, groups.drop("_all"), keys).withColumn("_at", curve()).join(groups.select(*keys, "_all"), keys)
    small = F.col("_all") <= whole
    along = placed.repartitionByRange(1 + total // max(4 * size, PART_ROWS), *keys, F.when(~small, F.col("_at")), "block_id").withColumn("_part", F.when(small, -1).otherwise(F.spark_partition_id()))
    number = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at", "block_id")) - 1
    told = along.withColumn("_block", F.when(small, 0).otherwise(F.floor(number / size)))
    edges = [f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
    names = [f"_{c}s" for c in body]
    lists = [F.collect_list(c).alias(n) for c, n in zip(body, names, strict=True)]
    made = told.groupBy(*keys, "_part", "_block").agg(F.count("*").alias("_n"), *edges, *lists)
    return cut(made.select(*keys, F.struct("_part", "_block").alias("_id"), "_n", *BOX, *names), "blocks")


def lag_sums(a: np.ndarray, av: np.ndarray, b: np.ndarray, bv: np.ndarray, own: bool, max_lag: float, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each lag and half their squared differences; of one block with itself, each pair once. Places are axis by axis."""
    n, g = np.zeros(lags + 2, np.int64), np.zeros(lags + 2)  # a distance just below max_lag can round up to ``lags``; the last is for all others
    low, high = b.min(1), b.max(1)

    def lag(d):
        return np.floor(d * lags / max_lag)

    def length(parts):
        return np.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])

    for i in range(0, len(av), TILE):
        p, pv = a[:, i : i + TILE], av[i : i + TILE]
        least, most = p.min(1), p.max(1)
        if not own:  # distances of boxes round as those of points do, so they bound them
            near, far = length(np.maximum(0, np.maximum(low - most, least - high))), length(np.maximum(high - least, most - low))
            if near >= max_lag:
                continue
            if far < max_lag and lag(near) == lag(far):
                s, t = pv - pv.mean(), bv - pv.mean()
                n[int(lag(near))] += len(s) * len(t)
                g[int(lag(near))] += (len(t) * (s * s).sum() + len(s) * (t * t).sum() - 2 * s.sum() * t.sum()) / 2
                continue
        first = i if own else 0
        q, qv = b[:, first:], bv[first:]
        close = length(np.maximum(0, np.maximum(q - most[:, None], least[:, None] - q))) < max_lag
        at = np.flatnonzero(close)
        q, qv = q[:, at], qv[at]
        d = length([p[k][:, None] - q[k] for k in range(3)])
        where = d * lags / max_lag
        where[d >= max_lag] = lags + 1
        if own:
            where[np.arange(len(pv))[:, None] >= at] = lags + 1
        where = where.astype(np.intp).ravel()
        gap = pv[:, None] - qv
        n += np.bincount(where, minlength=lags + 2)
        g += np.bincount(where, (gap * gap / 2).ravel(), lags + 2)
    n[-1] = 0
    return n, g


def variogram(rows: DataFrame, keys: list[str], max_lag: float, lags: int, whole: int) -> DataFrame:
    """``keys, lag, n, gamma`` of all pairs nearer than ``max_lag``; ``v`` must be finite, points without finite places have no pairs."""
    made = blocks(finite(rows.select(*keys, "block_id", *AXES, "v")), keys, whole)
    heads = [made.select(*keys, *(F.col(c).alias(f"{s}{c}") for c in ("_id", "_n", *BOX))) for s in "ab"]
    apart = [F.greatest(F.col(f"b_low{x}") - F.col(f"a_high{x}"), F.col(f"a_low{x}") - F.col(f"b_high{x}"), F.lit(0.0)) for x in AXES]
    met = heads[0].join(heads[1], keys).where(F.col("a_id") <= F.col("b_id")).where(F.sqrt(sum(d * d for d in apart)) < max_lag)
    pairs = cut(met.select(*keys, "a_id", "b_id", (F.col("a_n") * F.col("b_n")).alias("_work")), "pairs")
    work = pairs.agg(F.coalesce(F.sum("_work"), F.lit(0)).alias("pairs"), F.count("*").alias("blocks")).first()
    tasks = 1 + work["pairs"] // TASK_PAIRS + work["blocks"] // TASK_BLOCKS

    def bodies(s: str) -> DataFrame:
        return made.select(*keys, F.col("_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}{c}") for c in _BODY))

    # By the second block's key in so many parts: small ones would else be put together into few tasks.
    left = pairs.drop("_work").join(bodies("a"), [*keys, "a_id"]).repartition(tasks, *keys, "b_id")
    both = left.join(bodies("b").repartition(tasks, *keys, "b_id"), [*keys, "b_id"])
    both = both.select(*keys, (F.col("a_id") == F.col("b_id")).alias("_own"), *(f"{s}{c}" for s in "ab" for c in _BODY))
    schema = rows.select(*keys).schema.add("lag", "long").add("_n", "long").add("_g", "double")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in range(len(frame)):
                row = frame.iloc[i]
                a, b = (np.array([row[f"{s}{c}"] for c in _BODY], float) for s in "ab")
                n, g = lag_sums(a[:3], a[3], b[:3], b[3], bool(row["_own"]), max_lag, lags)
                found = np.flatnonzero(n)
                out.append(pd.DataFrame({"lag": found, "_n": n[found], "_g": g[found]}).assign(**{k: row[k] for k in keys}))
            if out:
                yield pd.concat(out)[[*keys, "lag", "_n", "_g"]]

    sums = both.mapInPandas(summed, schema)
    return sums.groupBy(*keys, "lag").agg(F.sum("_n").alias("n"), (F.sum("_g") / F.sum("_n")).alias("gamma"))
