"""The keyed store with several writers, failed runs, null keys and keys without results."""

import pytest
from pyspark.sql import functions as F

from lodecast.sources import store

KEYS = ["period", "domain"]


@pytest.fixture
def work(spark):
    return spark.createDataFrame([(13, "01", 1.0), (13, "01", 2.0), (14, "02", 5.0), (None, "a/b =", 7.0)], "period int, domain string, v double")


def _means(rows):
    return rows.groupBy(*KEYS).agg(F.avg("v").alias("v"))


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_each_key_is_computed_once(spark, work, tmp_path):
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return _means(rows)

    path = str(tmp_path / "s")
    assert _rows(store.shared(spark, path, work.where("period = 13"), KEYS, compute)) == [(13, "01", 1.5)]
    assert _rows(store.shared(spark, path, work, KEYS, compute)) == [(13, "01", 1.5), (14, "02", 5.0), (None, "a/b =", 7.0)]
    assert _rows(store.shared(spark, path, work.where("period = 14"), KEYS, compute)) == [(14, "02", 5.0)]
    assert seen == [2, 2]  # nothing is computed where all is there


def test_two_writers_leave_one_result_and_a_killed_one_none(spark, work, tmp_path):
    path = str(tmp_path / "s")
    schema = _means(work).schema
    a = store.draft(_means(work).withColumn("v", F.lit(1.0)), path, KEYS)
    b = store.draft(_means(work).withColumn("v", F.lit(2.0)), path, KEYS)
    store.draft(_means(work).withColumn("v", F.lit(3.0)), path, KEYS)  # killed before it was published
    assert store.published(spark, path, KEYS) is None and store.results(spark, path, work, KEYS, schema).isEmpty()
    store.publish(work.where("period = 14"), path, KEYS, b)
    store.publish(work, path, KEYS, a)
    store.publish(work, path, KEYS, b)
    assert _rows(store.results(spark, path, work, KEYS, schema)) == [(13, "01", 1.0), (14, "02", 2.0), (None, "a/b =", 1.0)]


def test_a_failing_run_leaves_nothing(spark, work, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(Exception, match="no result"):
        store.shared(spark, path, work, KEYS, lambda rows: _means(rows).withColumn("v", F.raise_error(F.lit("no result")).cast("double")))
    assert store.published(spark, path, KEYS) is None
    assert store.shared(spark, path, work, KEYS, _means).count() == 3


def test_keys_without_results_are_done(spark, work, tmp_path):
    path = str(tmp_path / "s")
    assert store.shared(spark, path, work, KEYS, lambda rows: _means(rows).where("v > 6")).count() == 1
    assert store.missing(spark, path, work, KEYS).isEmpty()
    assert store.shared(spark, path, work.limit(0), KEYS, _means).count() == 0


def test_lookups_prune_by_key(spark, work, tmp_path):
    path = str(tmp_path / "s")
    store.shared(spark, path, work, KEYS, _means)
    plan = store.results(spark, path, work.where("period = 14"), KEYS, _means(work).schema)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
