"""The table of all statistics of a model, from predictions and their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.operators import histogram, spatial, summary, uncertainty


def analysis_table(predictions: DataFrame, keys: list[str], model: str = "model", max_lag: float | None = None, lags: int = 45, required: int = 30, slack: float = 0.05) -> DataFrame:
    """One row for each model of each group: histogram distances and their rank, RMSE, variogram ratio and fidelity, quartiles of
    abs(s), consensus, accuracy, precision, goodness, tightness.

    ``predictions`` has ``keys, model, mu0, mu, sigma``, and ``block_id, x, y, z`` if
    ``max_lag`` asks for variograms; a group of fewer than ``required`` blocks has none. Each part is grouped by
    group and model, and the parts meet by these keys.
    """
    own = [*keys, model]
    found = histogram.rank_models(histogram.distances(predictions, own), keys, model)
    scored = uncertainty.with_synchronicity(predictions)
    table = (
        found.select(*own, "d_psi", "d_js", "d_iou", "d_em", F.col("rank_overall").alias("d_rank"))
        .join(summary.rmse(predictions, own).select(*own, "rmse"), own, "left")
        .join(uncertainty.consensus_quartiles(scored, own).select(*own, F.col("s25").alias("s_low"), F.col("s75").alias("s_high")), own, "left")
        .join(uncertainty.performance(scored, own, slack).select(*own, "consensus", "accuracy", "precision", "goodness", "tightness"), own, "left")
    )
    if max_lag is None:
        return table
    places = predictions.where("mu0 IS NOT NULL")
    enough = places.groupBy(*own).agg(F.count("*").alias("_n")).where(F.col("_n") >= required)
    wide = places.join(enough.select(*own), own, "left_semi")
    curves = spatial.variogram(wide.withColumn("v", F.col("mu")), own, max_lag, lags)
    # The truth is the same for every model of a group; one of them tells it.
    teller = wide.groupBy(*keys).agg(F.min(model).alias(model))
    truth = spatial.variogram(wide.join(teller, own, "left_semi").withColumn("v", F.col("mu0")).withColumn(model, F.lit("")), own, max_lag, lags)
    ratios = spatial.variogram_ratios(curves.unionByName(truth.select(curves.columns)), keys, "", model).where(F.col(model) != "")
    return table.join(ratios.select(*own, F.col("p50").alias("variogram_ratio"), "fidelity"), own, "left")


def with_reference(predictions: DataFrame, blocks: DataFrame, keys: list[str], name: str, value: str = "reference") -> DataFrame:
    """Predictions and, as one model more, a value that the blocks bring; it has no deviation."""
    extra = blocks.where(F.abs(value) < float("inf")).select(*keys, F.lit(name).alias("model"), "block_id", "mu0", F.col(value).alias("mu"), F.lit(None).cast("double").alias("sigma"))
    return predictions.select(*keys, "model", "block_id", "mu0", "mu", "sigma").unionByName(extra)


def best_models(table: DataFrame, keys: list[str], by: str = "d_rank") -> DataFrame:
    """The model of each group that a statistic puts first."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by, "model"))).where("_r = 1").drop("_r")
