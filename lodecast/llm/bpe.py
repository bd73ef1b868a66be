"""BPE encoding and decoding: a distinct-word table and an id-to-piece join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.llm.word_table import BLOCK_BYTES, assemble_blocks, buckets_for, packed_blocks, spans, tokenizer, unfolded


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id_col, ids binary)``: the ids of each text as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library for the whole text without added
    special tokens. A null text counts as empty and has no ids; null ids and
    repeated rows are kept; other columns are ignored, whatever their names; an
    empty table gives an empty result. A text must fit in a worker's memory.
    """
    base = packed_blocks(docs, id_col, text_col, block_bytes)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def rows(block: int, table: pa.Table, ids: np.ndarray, offsets: np.ndarray) -> pa.Table:
        values = spans(np.frombuffer(ids.tobytes(), np.uint8), 4 * offsets)
        return pa.table({"_id": table.column("_id"), "ids": values.cast(pa.binary())})

    return assemble_blocks(base, tokenizer_path, buckets_for(docs.sparkSession), rows, f"_id {kind}, ids binary", unfolded).withColumnRenamed("_id", id_col)


def id_to_piece(spark: SparkSession, tokenizer_path: str) -> DataFrame:
    """``(id int, piece string)`` for every id of the vocabulary, special tokens included."""
    model, _ = tokenizer(tokenizer_path)
    return spark.createDataFrame([(i, model.id_to_token(i)) for i in range(model.get_vocab_size())], "id int, piece string")


def decode(encoded: DataFrame, pieces: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text: the pieces of its ids joined by one space.

    This is what the tokenizers library gives for vocabularies without a decoder,
    special tokens included. The pieces are joined by id to the ids of each
    Arrow batch; the id-to-piece table goes to all tasks, as its size is fixed by
    the vocabulary (ids are 32-bit at most, here about 49,000 rows). Null ids give
    a null text, no ids an empty one; an id without a piece is an error.
    """
    known = {r["id"]: r["piece"] for r in pieces.collect()}
    kept = [c for c in encoded.columns if c != text_col]
    slim = encoded.select(*kept)
    schema = slim.withColumn(text_col, F.lit("").cast("string")).schema
    table: list[str | None] = [known.get(i) for i in range(max(known, default=-1) + 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = pa.array([None if p is None else b" " + p.encode() for p in table], pa.large_binary())
        for batch in batches:
            column = batch.column(ids_col)
            values = column.fill_null(b"").cast(pa.large_binary())
            n = len(values)
            offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8) if n else np.zeros(1, np.int64)
            data = values.buffers()[2] if n else None
            ids = np.frombuffer(data, "<u4")[offsets[0] // 4 : offsets[-1] // 4] if data is not None else np.zeros(0, "<u4")
            found = spaced.take(pa.array(ids, pa.uint32()))
            if found.null_count:
                raise ValueError("an id has no piece")
            if len(found):
                ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
                raw = np.frombuffer(found.buffers()[2], np.uint8)
            else:
                ends, raw = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            bounds = ends[(offsets - offsets[0]) // 4]
            texts = pa.compute.utf8_slice_codeunits(spans(raw, bounds).cast(pa.large_string()), 1)
            texts = pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.large_string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], names=[*kept, text_col])

    return slim.mapInArrow(read, schema)
