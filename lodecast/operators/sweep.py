"""Families of kriging models over many groups, with shared fits, stored results and their times."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.operators import workflow
from lodecast.operators.blocks import cut
from lodecast.settings import Settings
from lodecast.sources import store

#: Model families by name: whether the mean is unknown (ordinary) or 0.
FAMILIES = {"OK": True, "SK": False}
#: Settings that a fit depends on, and those that only predictions do.
FIT = ("rotated", "covariance", "smoothness", "training_points", "max_lag", "lags", "nugget", "margin", "scored", "least_scored")
PREDICT = ("neighbours", "least_neighbours")


def settings_key(settings: Settings, names: tuple[str, ...]) -> str:
    """A short name for the values of some settings; others may change without changing it."""
    told = asdict(settings)
    return hashlib.sha256(repr([(n, told[n]) for n in sorted(names)]).encode()).hexdigest()[:16]


def _timed(make: Callable[[], DataFrame]) -> DataFrame:
    """The frame, computed, with ``seconds``: the time of the run that made it, all its groups together."""
    start = time.perf_counter()
    made = cut(make())
    return made.withColumn("seconds", F.lit(time.perf_counter() - start))


def _of(rows: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(todo.select(*keys).distinct(), keys, "left_semi")


def fits(samples: DataFrame, blocks: DataFrame, keys: list[str], path: str, settings: Settings = Settings()) -> DataFrame:
    """The fit log: ``fit_all`` with ``seconds`` of every group of ``blocks``; what the store has is not fitted again."""
    groups = blocks.select(*keys).distinct()
    place = f"{path}/fits-{settings_key(settings, FIT)}"
    return store.shared(blocks.sparkSession, place, groups, keys, lambda todo: _timed(lambda: workflow.fit_all(_of(samples, todo, keys), _of(blocks, todo, keys), keys, settings)))


def sweep(samples: DataFrame, blocks: DataFrame, keys: list[str], path: str, settings: Settings = Settings(), families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """``keys, family, block_id, estimate, deviation, seconds`` of all families over all groups.

    Families share the fits. Fits and predictions lie in the store under the key of the settings that they depend on, so a
    second call only reads and a changed setting computes again what depends on it. Groups of one family are one plan. Samples are
    taken to be those of earlier calls with the same path; give new ones another path.
    """
    told = fits(samples, blocks, keys, path, settings)
    groups = blocks.select(*keys).distinct()
    found = None
    for family in families:
        def compute(todo: DataFrame, ordinary: bool = FAMILIES[family]) -> DataFrame:
            return _timed(lambda: workflow.krige_all(_of(samples, todo, keys), _of(blocks, todo, keys), keys, settings, ordinary=ordinary, parameters=told))

        place = f"{path}/{family}-{settings_key(settings, FIT + PREDICT)}"
        one = store.shared(blocks.sparkSession, place, groups, keys, compute).select(*keys, F.lit(family).alias("family"), "block_id", "estimate", "deviation", "seconds")
        found = one if found is None else found.unionByName(one)
    return found


def times(swept: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """The timing table: ``keys, family, n_training, n_blocks, learn_seconds, infer_seconds``; times are of the runs that computed a group."""
    inferred = swept.groupBy(*keys, "family").agg(F.count("*").alias("n_blocks"), F.max("seconds").alias("infer_seconds"))
    return inferred.join(fitted.select(*keys, F.col("n").alias("n_training"), F.col("seconds").alias("learn_seconds")), keys, "left").select(*keys, "family", F.coalesce("n_training", F.lit(0)).alias("n_training"), "n_blocks", "learn_seconds", "infer_seconds")
