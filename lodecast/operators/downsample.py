"""Samples of patches whose values are distributed as all values of their group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from lodecast.operators.blocks import dealt
from lodecast.operators.spatial import AXES

BINS = 100
#: Rows whose nearest rows are found together.
TILE = 256


def _bins(v: np.ndarray) -> np.ndarray:
    low, high = v.min(), v.max()
    return ((v - low) * BINS / ((high - low) or 1.0)).astype(int).clip(0, BINS - 1)


def _shares(bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, minlength=BINS) / len(bins)


def patch_size(rows: int, n: int) -> int:
    return min(rows, 1 + round(math.sqrt(n)))


def nearest(points: np.ndarray, centres: np.ndarray, size: int) -> np.ndarray:
    """Row numbers of the ``size`` nearest points of each centre, a row for each."""
    out = np.empty((len(centres), size), np.int32)
    for i in range(0, len(centres), TILE):
        c = points[centres[i : i + TILE]]
        far = sum((points[:, k] - c[:, k, None]) ** 2 for k in range(3))
        out[i : i + TILE] = np.argpartition(far, size - 1, axis=1)[:, :size]
    return out


def patches(near: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` row numbers: the nearest rows (``near``, a row for each) of random centres, more centres until there are enough."""
    got, wanted = np.zeros(len(near), bool), max(1, round(math.sqrt(n)))
    while got.sum() < n:
        got[near[rng.integers(0, len(near), wanted)]] = True
        wanted *= 2
    return rng.permutation(np.flatnonzero(got))[:n]


def downsample(rows: DataFrame, keys: list[str], n: int, workers: int = 8, trials: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``n`` of ``rows`` for each group: of many samples made of patches, that with the least divergence.

    A group with at most n rows keeps them all. Each of ``workers`` tasks of a
    larger group makes ``trials`` samples (as many as a task's share of the rows, if
    none are named) and hands back its best one's ids, so a task holds one group's
    points and values. The divergence is that of shares in 100 bins. Before that the tasks find the
    nearest rows of their share of the rows, once for all samples.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = rows.join(counts.where(F.col("_n") <= n), keys, "left_semi")
    lean = rows.join(counts.where(F.col("_n") > n), keys, "left_semi").select(*keys, "block_id", *AXES, "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("_worker")
    own = [*keys, "_worker"]
    spread = dealt(lean.select("*", every), own)
    lists = spread.select(*own).schema.add("_near", BinaryType())

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block_id")
        centres = np.arange(int(frame._worker.iloc[0]), len(frame), workers)
        near = nearest(frame[list(AXES)].to_numpy(float), centres, patch_size(len(frame), n))
        return frame[own].head(1).assign(_near=[near.tobytes()])

    schema = lean.select(*keys).schema.add("_kl", "double").add("_ids", ArrayType(LongType()))

    def search(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        frame = frame.sort_values("block_id")
        near = np.empty((len(frame), patch_size(len(frame), n)), np.int32)
        for part, held in zip(told._of, told._near, strict=True):
            near[part::workers] = np.frombuffer(held, np.int32).reshape(-1, near.shape[1])
        rng, bins = np.random.default_rng([seed, int(frame._worker.iloc[0])]), _bins(frame.v.to_numpy(float))
        whole, best = _shares(bins), (math.inf, None)
        for _ in range(max(1, len(bins) // workers if trials is None else trials)):
            at = patches(near, n, rng)
            p = _shares(bins[at])
            kl = float((p[p > 0] * np.log(p[p > 0] / whole[p > 0])).sum())
            if kl < best[0]:
                best = (kl, at)
        return frame[keys].head(1).assign(_kl=best[0], _ids=[frame.block_id.to_numpy()[best[1]].tolist()])

    shares = spread.groupBy(*own).applyInPandas(share, lists)
    told = shares.select(*keys, F.col("_worker").alias("_of"), "_near", every)
    chosen = spread.groupBy(*own).cogroup(dealt(told.toDF(*told.columns), own).groupBy(*own)).applyInPandas(search, schema).groupBy(*keys).agg(F.min_by("_ids", F.struct("_kl", "_ids")).alias("_ids"))
    return small.unionByName(rows.join(chosen.select(*keys, F.explode("_ids").alias("block_id")), [*keys, "block_id"], "left_semi"))
