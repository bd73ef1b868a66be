"""Resampling of documents towards a target's distribution of hashed n-gram features, in DataFrame functions.

A document is an array of buckets, one for each run of 1 to 3 words; a bucket's
gain is the logarithm of how much more common it is in the target. Arrays are
made once, by higher-order functions, and written. Of them only bucket totals
are shuffled (10,000 rows of each task at most); scores are an aggregate over
``element_at`` of the gains as one literal array, so no feature becomes a row
there. Gumbel noise from a hash of the id turns "the highest scores" into a draw
without replacement. The draw cuts by an approximate quantile first, then
orders only the rows above it, by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecast.llm.files import written

BUCKETS, RUNS, UNIT = 10_000, 3, 1000
#: The draw: so many percent of the documents with so many words at least.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Ranks of the approximate quantile are this share off at most, by its accuracy of 1 / share.
SLACK = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucket_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``id_col, _n_words, _buckets``: the bucket of every run of 1 to 3 words of the whole text, repeats kept.

    A-Z are lower-cased; words are runs of a-z, 0-9 and characters beyond ASCII. A bucket is
    the CRC-32 of the run's UTF-8 bytes modulo ``buckets``. A null or empty text has none. Other columns are ignored.
    """
    low = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    words = F.filter(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    split = docs.select(F.col(id_col).alias(id_col), words.alias("_words"))
    parts = []
    for n in range(1, RUNS + 1):
        run = ", ' ', ".join(["w", *(f"get(_words, i + {k})" for k in range(1, n))])
        # Runs that reach past the last word are cut off by their number.
        parts.append(f"slice(transform(_words, (w, i) -> int(crc32(concat({run})) % {buckets})), 1, greatest(size(_words) - {n - 1}, 0))")
    return split.select(id_col, F.size("_words").cast("long").alias("_n_words"), F.expr(f"concat({', '.join(parts)})").alias("_buckets"))


def bucket_totals(arrays: DataFrame) -> DataFrame:
    """``_bucket, _n``: how often each bucket occurs; tasks count their own rows first."""
    return arrays.select(F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))


def gains(all_totals: DataFrame, target_totals: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: floor(1000 ln of its smoothed share in the target over that in all documents).

    At most ``buckets`` rows come to the driver, whatever the tables' sizes.
    """
    spark = all_totals.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
        .join(all_totals.withColumnRenamed("_n", "_s"), "_bucket", "left")
        .join(target_totals.withColumnRenamed("_n", "_t"), "_bucket", "left")
        .fillna(0, ["_s", "_t"])
    )
    both = written(both, "bucket-totals")
    whole = both.agg(F.sum("_s").alias("s"), F.sum("_t").alias("t")).first()
    part = (F.col("_t") + 1).cast("double") * float(whole.s + buckets)
    ratio = part / ((F.col("_s") + 1).cast("double") * float(whole.t + buckets))
    found = both.select("_bucket", F.floor(UNIT * F.log(ratio)).alias("_g")).collect()
    return [row["_g"] for row in sorted(found)]


def scored(arrays: DataFrame, gain: list[int], id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``id_col, _n_words, n_features, weight, score``: the sum of gains, and that with Gumbel noise.

    The noise is a function of seed and id alone; a null id counts as an empty text.
    """
    # A constant text that the optimizer turns into one literal array; as many single literals would each be an expression.
    table = F.from_json(F.lit(str(gain)), "array<bigint>")
    weight = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b + 1))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(-float(UNIT) * F.log(-F.log(draw)))
    found = arrays.select(id_col, "_n_words", F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("_noise"))
    return found.select(id_col, "_n_words", "n_features", "weight", (F.col("weight") + F.col("_noise")).alias("score"))


def drawn(scores: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, 3.. for the floor(percent * N / 100) highest of the N documents that are long enough, else null.

    Ties go to the smaller id (null first); equal rows in any order. ``scores`` are read several times, so they should be a
    written table. Only rows above an approximate quantile are ordered: dealt by ranges
    of (score, id), counted, and numbered within their range; no task sees them all.
    """
    fit: Column = F.coalesce(F.col("_n_words") >= least_words, F.lit(False))
    share = max(0.0, 1 - percent / 100 - 10 * SLACK)
    seen = scores.where(fit).agg(F.count("*").alias("n"), F.percentile_approx("score", F.lit(share), round(1 / SLACK)).alias("low")).first()
    wanted = percent * seen.n // 100
    above = fit & (F.col("score") >= F.lit(seen.low)) if wanted else F.lit(False)
    if wanted and scores.where(above).count() < wanted:  # the sketch does not promise what its error allows
        above = fit
    order = [F.col("score").desc(), F.col(id_col).asc()]
    dealt = written(scores.where(above).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "drawn")
    sizes = {row["_range"]: row["n"] for row in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.element_at(F.from_json(F.lit(str(before)), "array<bigint>"), F.col("_range") + 1)
    ranked = dealt.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scores.where(~above).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("_range").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row of ``docs``.

    ``target`` needs ``text_col`` only. Null and empty texts have no feature, weight 0, and are never drawn; repeated rows
    count and are drawn as they come; a null id is drawn with the noise of an empty id. An empty target gives every bucket the
    smoothed share alone; empty documents give an empty result.
    """
    arrays = written(bucket_arrays(docs, id_col, text_col), "buckets")
    aim = bucket_arrays(target.select(F.lit(0).alias("_target_id"), F.col(text_col).alias("_target_text")), "_target_id", "_target_text")
    found = scored(arrays, gains(bucket_totals(arrays), bucket_totals(aim)), id_col, seed)
    return drawn(written(found, "scores"), id_col, percent, least_words).drop("_n_words")
