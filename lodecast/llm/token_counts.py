"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are gathered into batches of about ``batch_bytes``; every text is split at
boundaries that no piece of the model crosses, equal parts of a batch are
encoded once, and the lengths are added up by text. A text of any length is so
handled in parts of a word's size, and nothing is shuffled.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm.splitting import split_pieces

#: Text bytes that are encoded together; bounds the memory of a Python worker.
BATCH_BYTES = 8 << 20
#: Part lengths that a worker remembers between batches.
CACHE_PARTS = 300_000


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory of finished batches back, as workers live on and would otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def balanced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Regroups Arrow batches so that each has about ``limit`` bytes of text (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(column)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                release()
    if held:
        yield pa.Table.from_batches(held)
        held = []
    release()


class PieceLengths:
    """Token counts of texts under a sentencepiece model, with equal parts encoded once."""

    def __init__(self, model_path: str, cache_parts: int = CACHE_PARTS) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._known: dict[bytes, int] = {}
        self._most = cache_parts

    def _lengths(self, parts: list[bytes]) -> list[int]:
        known = self._known
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > self._most:
            known.clear()
            new = parts
        for start in range(0, len(new), 20_000):
            own = new[start : start + 20_000]
            texts = [(p[1:] if p[:1] == b" " else p).decode() for p in own]
            ids = self._model.encode(texts, num_threads=1)
            known.update((p, len(i) - (p[:1] != b" ")) for p, i in zip(own, ids, strict=True))
        known[b" "] = 1
        return [known[p] for p in parts]

    def count(self, column: pa.Array) -> np.ndarray:
        parts, first = split_pieces(column)
        if len(parts) == 0:
            return np.zeros(len(first) - 1, np.int64)
        coded = parts.dictionary_encode()
        lengths = np.array(self._lengths(coded.dictionary.to_pylist()), np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
        empty = np.asarray(pa.compute.binary_length(column.fill_null(""))) == 0
        return np.where(empty, 0, ends[first[1:]] - ends[first[:-1]])


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``(id_col, n_bytes long, n_tokens long)`` for every row of ``docs``.

    Null texts count as empty (0 tokens); null ids and repeated rows are kept as
    they come; other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceLengths(model_path)
        for table in balanced(batches, "_text", batch_bytes):
            text = table.column("_text").combine_chunks()
            counts = pa.array(counter.count(text))
            sizes = pa.compute.cast(pa.compute.binary_length(text), pa.int64())
            yield from pa.table({"_id": table.column("_id"), "n_bytes": sizes, "n_tokens": counts}).to_batches()

    found = slim.mapInArrow(lengths, f"_id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
