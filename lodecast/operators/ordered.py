"""Running sums and neighbouring rows of large groups, from one order of all rows over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators.blocks import cut

#: Parts for each task of a shuffle: parts are spread by their hash, so small ones even out.
FINER = 4


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written with ``_part``: parts rise with ``order`` and hold about equally many rows, whatever the values are.

    Spark draws the borders from a sample of the rows. Equal rows lie in one part, so they are to be counted together first.
    """
    parts = FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def running(rows: DataFrame, keys: list[str], order: list[str], sums: tuple[str, ...] = (), previous: tuple[str, ...] = (), following: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``in_order(rows, keys + order)`` with ``c_before`` and ``c_all`` of ``sums``, ``c_previous`` and ``c_following``.

    Sums are those of the group's rows before a row and of all; neighbours are null at the group's ends. A window goes over the
    rows of one part; between parts go only the sums and the end rows of each, one row for each part of a group. Null keys are a group.
    """
    at = F.struct(*order)

    def end(c: str, last: bool):
        if order == [c]:  # a plain least or greatest value needs no sort
            return F.max(c) if last else F.min(c)
        return F.max_by(c, at) if last else F.min_by(c, at)

    ends = rows.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"),
        *(F.sum(c).alias(f"_s_{c}") for c in sums),
        *(end(c, True).alias(f"_p_{c}") for c in previous),
        *(end(c, False).alias(f"_f_{c}") for c in following),
    )
    group = Window.partitionBy(*keys)
    parts = group.orderBy("_part")
    before = (Window.unboundedPreceding, -1)
    told = ends.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_part").alias("_of"),
        "_rows",
        *(F.coalesce(F.sum(f"_s_{c}").over(parts.rowsBetween(*before)), F.lit(0)).alias(f"_s_{c}") for c in sums),
        *(F.sum(f"_s_{c}").over(group).alias(f"{c}_all") for c in sums),
        *(F.lag(f"_p_{c}").over(parts).alias(f"_p_{c}") for c in previous),
        *(F.lead(f"_f_{c}").over(parts).alias(f"_f_{c}") for c in following),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    own = rows.select(
        "*",
        *([F.row_number().over(within).alias("_first")] if previous or following else []),
        *(F.coalesce(F.sum(c).over(within.rowsBetween(*before)), F.lit(0)).alias(f"_i_{c}") for c in sums),
        *(F.lag(c).over(within).alias(f"_l_{c}") for c in previous),
        *(F.lead(c).over(within).alias(f"_n_{c}") for c in following),
    )
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(told, same).select(
        *rows.columns,
        *((F.col(f"_s_{c}") + F.col(f"_i_{c}")).alias(f"{c}_before") for c in sums),
        *(f"{c}_all" for c in sums),
        *(F.when(F.col("_first") == 1, F.col(f"_p_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{c}_previous") for c in previous),
        *(F.when(F.col("_first") == F.col("_rows"), F.col(f"_f_{c}")).otherwise(F.col(f"_n_{c}")).alias(f"{c}_following") for c in following),
    )
