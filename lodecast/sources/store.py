"""Results by key that several runs can share: drafts that count once they are published."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut


def _folder(keys: list[str]):
    return F.hex(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))


def draft(rows: DataFrame, path: str, keys: list[str]) -> str:
    """Writes results as a draft, one folder for each hash of the keys, and returns the run's name. Nobody reads it yet."""
    run = uuid.uuid4().hex
    rows.withColumn("folder", _folder(keys)).repartition("folder").write.partitionBy("folder").parquet(f"{path}/drafts/run={run}")
    return run


def publish(done: DataFrame, path: str, keys: list[str], run: str) -> None:
    """Makes a draft count for the keys of ``done``, those without results too.

    The run's keys are one file, which is there whole or not at all. It has one row for each key, written by one task.
    """
    stamped = done.select(*keys).distinct().select(*keys, F.lit(run).alias("run"), F.lit(time.time()).alias("published"))
    stamped.coalesce(1).write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """``keys, run``: of each key the run that was published first, ties by name; None before any was."""
    try:
        rows = spark.read.parquet(f"{path}/published")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    return rows.groupBy(*keys).agg(F.min(F.struct("published", "run")).alias("_first")).select(*keys, F.col("_first.run").alias("run"))


def _same(left: list[str], right: list[str]):
    both = F.lit(True)
    for a, b in zip(left, right, strict=True):
        both = both & F.col(a).eqNullSafe(F.col(b))
    return both


def missing(spark: SparkSession, path: str, work: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose keys have no published run. Null keys are keys."""
    known = published(spark, path, keys)
    if known is None:
        return work
    names = [f"_k{i}" for i in range(len(keys))]
    return work.join(known.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))), _same(keys, names), "left_anti")


def results(spark: SparkSession, path: str, work: DataFrame, keys: list[str], schema) -> DataFrame:
    """Published results, of ``schema``, for the keys of ``work``: of each key those of one run, read from that key's folders only.

    Folders and runs are partitions, so a join with the few wanted ones prunes the scan while it runs.
    """
    known = published(spark, path, keys)
    if known is None:
        return spark.createDataFrame([], schema)
    names = [f"_k{i}" for i in range(len(keys))]
    asked = work.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).distinct()
    wanted = known.join(asked, _same(keys, names), "left_semi").withColumn("folder", _folder(keys))
    wanted = wanted.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("run").alias("_run"), F.col("folder").alias("_folder"))
    columns = [f.name for f in schema.fields]
    full = spark.createDataFrame([], schema).selectExpr("*", "'' AS run", "'' AS folder").schema
    rows = spark.read.schema(full).parquet(f"{path}/drafts")
    return rows.join(wanted, (F.col("run") == F.col("_run")) & (F.col("folder") == F.col("_folder")) & _same(keys, names)).select(*columns)


def shared(spark: SparkSession, path: str, work: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all keys of ``work``; ``compute(rows)`` runs for rows whose keys have none yet, and its results, with ``keys``, are published.

    Two runs may compute a key at one time: one of them counts. A run that fails leaves drafts that nobody reads. Columns of
    results must not be named run or folder.
    """
    todo = cut(missing(spark, path, work, keys))
    if todo.isEmpty() and published(spark, path, keys) is not None:
        return results(spark, path, work, keys, spark.read.parquet(f"{path}/drafts").drop("run", "folder").schema)
    found = compute(todo)
    if not todo.isEmpty():
        publish(todo, path, keys, draft(found, path, keys))
    return results(spark, path, work, keys, found.schema)
