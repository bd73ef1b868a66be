"""Driver queries of the subpackage: opN_<name> and the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document over this many tokens is reported as over the limit.
TOKEN_LIMIT = 4096


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodecast.llm.bpe import decode, encode, id_to_piece

    path = public_tokenizers.path("word_bpe_49k.json")
    read = decode(encode(_read(spark, sf_dir, "documents"), path), id_to_piece(spark, path))
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.quality_rules import apply_rules

    return apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.warc import normalise_archives, read_archives, write_archives

    archives = normalise_archives(write_archives(_read(spark, sf_dir, "pages")), remove_sources=True)
    return read_archives(archives, with_payload=False).drop("url")


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodecast.llm.wavelet import read_shards, write_shards

    manifest = write_shards(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "n_ends"
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.pii import BASE, find_personal_data

    found = find_personal_data(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(kind)), False)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op6_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.lsh_forest import similar_classes

    return similar_classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.winnowing import find_hits

    found = find_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.quality_model import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.html_blocks import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodecast.llm.token_counts import count_tokens

    counts = count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.importance import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.hard_negatives import integer_vectors, mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_vectors(_read(spark, sf_dir, "embeddings"), label=label)
    return mine(vectors, vectors.where("_id % 100 = 0"))


#: A conversation more, as a record of another layout, whose texts look like control strings.
CONTROL_RECORD = (-1, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}')


def op13_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodecast.llm.chat import digests, formatted, parsed, turns_of_records, turns_of_rows

    rows = turns_of_rows(_read(spark, sf_dir, "conversations"))
    more, _ = turns_of_records(spark.createDataFrame([CONTROL_RECORD], "id long, record string"), "id", "record")
    return digests(parsed(formatted(rows.unionByName(more))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_risk_controlled_rules": op2_risk_controlled_rules,
        "op3_warc_members": op3_warc_members,
        "op4_wavelet_shards": op4_wavelet_shards,
        "op5_personal_data": op5_personal_data,
        "op6_lsh_forest_join": op6_lsh_forest_join,
        "op7_pu_quality": op7_pu_quality,
        "op8_winnowing": op8_winnowing,
        "op9_block_rules": op9_block_rules,
        "op10_token_counts": op10_token_counts,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_chat_turns": op13_chat_turns,
    }


def oracle_sql() -> dict[str, str]:
    from lodecast.llm.oracles import ORACLES

    return dict(ORACLES)
