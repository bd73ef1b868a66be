"""Readers and writers of experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "EAST double, NORTH double, RL double, PL_CU double, lookup_domain int"
BLOCK_SCHEMA = "X double, Y double, Z double, MINED int, cu_bh_nn double, cu_50 double, domain int"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Drill samples as ``x, y, z, v, domain``, finite values only."""
    rows = spark.read.schema(SAMPLE_SCHEMA).csv(path, header=True)
    named = rows.toDF("x", "y", "z", "v", "domain")
    return named.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")


#: The file of the blocks of each kind of inference, in a period's folder.
BLOCK_FILES = {"future-bench": "blocks_to_estimate_tagged.csv", "in-situ": "blocks_insitu_tagged.csv"}


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks to estimate as ``x, y, z, mined, mu0, reference, domain``."""
    return spark.read.schema(BLOCK_SCHEMA).csv(path, header=True).toDF("x", "y", "z", "mined", "mu0", "reference", "domain")


def read_all_blocks(spark: SparkSession, folder: str, inference: str = "future-bench") -> DataFrame:
    """Blocks of all periods, with ``period`` from the name of their folder (such as 13_14_15)."""
    rows = read_blocks(spark, f"{folder}/*/{BLOCK_FILES[inference]}")
    return rows.withColumn("period", F.regexp_extract(F.input_file_name(), "/([0-9]{2})_[0-9]{2}_[0-9]{2}/[^/]*$", 1).cast("int"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Ellipses of domains: ``name, domain_id, angle1..3`` (degrees), ``search1x..z`` (radii)."""
    return spark.read.schema("name string, domain_id int, angle1 double, angle2 double, angle3 double, search1x double, search1y double, search1z double").csv(path, header=True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Sample counts and percentiles of each period and domain; the period's heading is ``# mA``."""
    names = ["period", "domain", "n_blastholes", "n_inference_pts", *(f"p{i}" for i in range(7))]
    schema = ", ".join(f"{n} {'int' if i < 4 else 'double'}" for i, n in enumerate(names))
    return spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True)


def read_analysis(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Analysis tables of several runs as one; what older ones call Likelihood is Consensus.

    Without ``schema``, the types and columns of each file are inferred by themselves; with it, all files have its columns and are one read.
    """
    parts = [spark.read.csv(path, header=True, inferSchema=True) for path in paths] if schema is None else [spark.read.schema(schema).csv(paths, header=True)]
    out = None
    for rows in parts:
        if "Likelihood" in rows.columns:
            rows = rows.withColumnRenamed("Likelihood", "Consensus")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def ellipse_of(ellipses: DataFrame, name: str) -> DataFrame:
    """Variables and values of one domain of a table of ellipses."""
    row = ellipses.where(F.col("name") == name)
    return row.select(F.explode(F.map_entries(F.create_map(*(x for c in row.columns if c != "name" for x in (F.lit(c), F.col(c).cast("string")))))).alias("e")).select("e.key", "e.value")


def domains(samples: DataFrame, key: str = "domain") -> DataFrame:
    """The domains that samples have."""
    return samples.select(key).where(F.col(key).isNotNull()).distinct()


def read_ellipses(spark: SparkSession, path: str) -> DataFrame:
    """A text table of variables by domain, as one row for each domain.

    Fields are parted by commas or equal signs, ``#`` starts a comment, and rows
    are named ``%VAR name``; the first row holds the domains' names.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    fields = lines.select(F.transform(F.split("line", "[,=]"), lambda f: F.trim(F.regexp_replace(f, "^%VAR ", ""))).alias("f"))
    cells = fields.select(F.col("f")[0].alias("name"), F.posexplode(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0)))).alias("place", "value"))
    return cells.groupBy("place").pivot("name").agg(F.first("value")).drop("place")


def write_results(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Results as Parquet, one folder for each combination of the keys; others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_parameters(spark: SparkSession, found: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys the table does not have yet."""
    from pyspark.errors import AnalysisException

    try:
        found = found.join(spark.read.parquet(path), keys, "left_anti")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    found.write.mode("append").parquet(path)


def known_parameters(spark: SparkSession, wanted: DataFrame, path: str, keys: list[str], values: str = "range double, sill double, nugget double") -> DataFrame:
    """``wanted`` with the parameters that the table has for its keys, the earliest of several; null where it has none.

    ``values`` are the columns that there are, all null, while no table has been written.
    """
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = spark.createDataFrame([], wanted.select(*keys).schema).selectExpr("*", *(f"CAST(NULL AS {t.strip().rsplit(' ', 1)[1]}) AS {t.strip().rsplit(' ', 1)[0]}" for t in values.split(",")))
    columns = [c for c in known.columns if c not in keys]
    order = F.struct(*(c for c in ("timestamp", *columns) if c in known.columns))
    first = known.groupBy(*keys).agg(F.min(order).alias("_first"))
    return wanted.join(first.select(*keys, *(F.col(f"_first.{c}") for c in columns)), keys, "left")


def sort_parameters(spark: SparkSession, path: str, into: str, keys: list[str]) -> None:
    """The parameter table anew, in the order of its keys."""
    spark.read.parquet(path).orderBy(*keys).write.mode("overwrite").parquet(into)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``work`` without a result yet."""
    return work.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def read_or_compute(spark: SparkSession, path: str, work: DataFrame, keys: list[str], compute) -> DataFrame:
    """Results of all keys of ``work``: ``compute(rows)`` runs for the rows whose keys the table lacks, and is added to it."""
    from pyspark.errors import AnalysisException

    try:
        missing = work.join(remaining(work, spark.read.parquet(path), keys), keys, "left_semi")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        missing = work
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(work.select(*keys).distinct(), keys, "left_semi")


def write_once(rows: DataFrame, path: str) -> None:
    """A table that is only written where there is none, such as the times of a run or the log of its fits."""
    rows.write.mode("ignore").parquet(path)
