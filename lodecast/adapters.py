"""Spatial views on the driver's tables: samples, predictions, simulations and domain geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models that are made of the truth m and the quantity q, tax t and discount d of a line: mean and deviation.
MODELS = {
    "biased": ("m + 40 * d + q / 10", "2 + q / 5"),
    "blend": ("m * 4 / 5 + q * 2 / 5", "5 + 100 * t"),
    "flat": ("53 + 0 * m", "30 + 0 * m"),
    "tight": ("53 + 0 * m", "8 + 0 * m"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: dealt out anew only where the files give fewer partitions than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``block_id, domain, period, x, y, z, v`` from the first four vector components."""
    part = [F.round(F.element_at("embedding", i).cast("double") * 1000, 6).alias(n) for i, n in enumerate(("x", "y", "z", "v"), 1)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("label").alias("domain"), (13 + F.col("vec_id") % 3).cast("int").alias("period"), *part)


SAMPLES = """s AS (SELECT vec_id AS block_id, label AS domain, (13 + vec_id % 3)::INT AS period,
  round(embedding[1]::DOUBLE * 1000, 6) AS x, round(embedding[2]::DOUBLE * 1000, 6) AS y, round(embedding[3]::DOUBLE * 1000, 6) AS z, round(embedding[4]::DOUBLE * 1000, 6) AS v FROM embeddings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain, model, mu0, mu, sigma`` of four models of each line's price."""
    base = spread(table(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS domain", "l_extendedprice / 1000 AS m", "l_quantity AS q", "l_tax AS t", "l_discount AS d"))
    stacked = ", ".join(f"struct('{k}' AS model, CAST({m} AS DOUBLE) AS mu, CAST({s} AS DOUBLE) AS sigma)" for k, (m, s) in MODELS.items())
    return base.selectExpr("domain", "m AS mu0", f"explode(array({stacked})) AS x").select("domain", "x.model", "mu0", "x.mu", "x.sigma")


PREDICTIONS = "l AS (SELECT l_linestatus AS domain, l_extendedprice / 1000 AS m, l_quantity AS q, l_tax AS t, l_discount AS d FROM lineitem), pred AS (" + " UNION ALL ".join(f"SELECT domain, '{k}' AS model, m AS mu0, CAST({m} AS DOUBLE) AS mu, CAST({s} AS DOUBLE) AS sigma FROM l" for k, (m, s) in MODELS.items()) + ")"


def simulations(spark: SparkSession, sf_dir: str, every: int = 5) -> DataFrame:
    """``domain, block_id, sim, value``: eight realisations of every fifth sample, or of all with ``every`` 1."""
    base = samples(spark, sf_dir).where(f"block_id % {every} = 0").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return base.select("domain", "block_id", "sim", (F.col("v") + (F.col("block_id") * 31 + F.col("sim") * 17) % 23 - 11).alias("value"))


SIMULATIONS = f"{SAMPLES}, sims AS (SELECT domain, block_id, sim, v + (block_id * 31 + sim * 17) % 23 - 11 AS value FROM s, (SELECT unnest(generate_series(0, 7)) AS sim) WHERE block_id % 5 = 0)"


ALL_SIMULATIONS = f"{SAMPLES}, sims AS (SELECT domain, block_id, sim, v + (block_id * 31 + sim * 17) % 23 - 11 AS value FROM s, (SELECT unnest(generate_series(0, 7)) AS sim))"


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain_id, angle1..3, search1x..z`` for each nation."""
    k = "n_nationkey"
    return table(spark, sf_dir, "nation").selectExpr(f"{k} * 111 + 2110 AS domain_id", f"CAST({k} * 7 % 90 AS DOUBLE) AS angle1", f"CAST({k} * 5 % 45 AS DOUBLE) AS angle2", f"CAST({k} * 3 % 30 AS DOUBLE) AS angle3", f"CAST(100 + {k} * 10 AS DOUBLE) AS search1x", f"CAST(80 + {k} * 5 AS DOUBLE) AS search1y", "CAST(40 AS DOUBLE) AS search1z", f"CAST({k} - 12 AS DOUBLE) AS x", f"CAST(2 * {k} + 1 AS DOUBLE) AS y", f"CAST(7 - {k} AS DOUBLE) AS z")


GEOMETRY = "g AS (SELECT n_nationkey * 111 + 2110 AS domain_id, (n_nationkey * 7 % 90)::DOUBLE AS angle1, (n_nationkey * 5 % 45)::DOUBLE AS angle2, (n_nationkey * 3 % 30)::DOUBLE AS angle3, (100 + n_nationkey * 10)::DOUBLE AS search1x, (80 + n_nationkey * 5)::DOUBLE AS search1y, 40::DOUBLE AS search1z, (n_nationkey - 12)::DOUBLE AS x, (2 * n_nationkey + 1)::DOUBLE AS y, (7 - n_nationkey)::DOUBLE AS z FROM nation)"


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``period, domain, model, v, w`` from events: values and whole weights."""
    return table(spark, sf_dir, "events").selectExpr("CAST(weekofyear(ts) AS INT) AS period", "user_id % 11 AS domain", "event_type AS model", "value AS v", "1 + user_id % 7 AS w")


ANALYSIS = "a AS (SELECT weekofyear(ts)::INT AS period, user_id % 11 AS domain, event_type AS model, value AS v, 1 + user_id % 7 AS w FROM events)"


#: Models of a sample's value v at its place, by block id b: mean and deviation.
PLACED_MODELS = {"blend": ("v * 4 / 5 + 5 * (b % 7 - 3)", "15 + b % 5"), "shifted": ("v + 10 + 0 * b", "20 + 0 * b")}


def placed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain, model, block_id, x, y, z, mu0, mu, sigma`` of two models of each sample's value."""
    stacked = ", ".join(f"struct('{k}' AS model, CAST({m} AS DOUBLE) AS mu, CAST({d} AS DOUBLE) AS sigma)" for k, (m, d) in PLACED_MODELS.items())
    rows = samples(spark, sf_dir).withColumn("b", F.col("block_id"))
    return rows.selectExpr("domain", "block_id", "x", "y", "z", "v AS mu0", f"explode(array({stacked})) AS m").select("domain", "m.model", "block_id", "x", "y", "z", "mu0", "m.mu", "m.sigma")


PLACED_PREDICTIONS = f"{SAMPLES}, pred AS (" + " UNION ALL ".join(f"SELECT domain, '{k}' AS model, block_id, x, y, z, v AS mu0, CAST({m} AS DOUBLE) AS mu, CAST({d} AS DOUBLE) AS sigma FROM (SELECT *, block_id AS b FROM s)" for k, (m, d) in PLACED_MODELS.items()) + ")"
