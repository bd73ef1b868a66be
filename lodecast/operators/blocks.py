"""Large groups cut into blocks that each meet their group's small side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups up to whose number a table of one row a group is held by the driver and sent to all tasks.
HELD_GROUPS = 10_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place (not yet made) under ``spark.checkpoint.dir``, which the cluster names.

    Without that setting a session on one machine takes a folder there; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
    top = f"file://{top}" if top.startswith("/") else top
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    """The frame, written once to the shared folder and read back: what follows does not compute it again and knows its size."""
    place = shared_folder(frame.sparkSession, name)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)


def held(side: DataFrame) -> DataFrame:
    """A table of one row for each group, computed once and broadcast if its groups are few; otherwise as it is."""
    rows = side.limit(HELD_GROUPS + 1).collect()
    return side if len(rows) > HELD_GROUPS else F.broadcast(side.sparkSession.createDataFrame(rows, side.schema))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` by keys over all parts of a shuffle: groups of few rows and much work would else be put together into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_blocks(rows: DataFrame, side: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_b``: ``rows`` are spread over blocks of about ``size``, ``side`` is repeated for each block of its group."""
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("long").alias("_blocks"))
    cut = rows.join(blocks, keys).withColumn("_b", F.pmod(F.xxhash64("block_id"), "_blocks")).drop("_blocks")
    told = side.join(blocks, keys).withColumn("_b", F.explode(F.expr("sequence(0L, _blocks - 1)"))).drop("_blocks")
    return cut.toDF(*cut.columns), told.toDF(*told.columns)  # columns of their own, though both may come from one frame


def numbered(side: DataFrame, name: str) -> DataFrame:
    """A table of one row for each group with ``name``, its number from 0 on, as ``held`` gives it: no two groups have one number."""
    rows = side.limit(HELD_GROUPS + 1).collect()
    if len(rows) <= HELD_GROUPS:
        schema = side.schema.add(name, "long")
        return F.broadcast(side.sparkSession.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema))
    at = F.monotonically_increasing_id()
    parted = cut(side.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(2**33 - 1)}))
    before, total = {}, 0
    for row in sorted(parted.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before[row["_part"]], total = total, total + row["n"]
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return parted.withColumn(name, F.element_at(starts, F.col("_part")) + F.col("_row")).drop("_part", "_row")
