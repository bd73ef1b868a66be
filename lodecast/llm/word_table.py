"""Encoding through a distinct-word table that spans the whole corpus.

Documents lie in blocks of bounded size. Each block asks for its distinct words,
sorted and packed by word bucket; each bucket joins the requests of all blocks,
encodes every distinct word once and answers the blocks; each block then joins
the ids back to its words by position. What is shuffled are the texts once and
distinct words per block, never a row for each occurrence, and a frequent word
costs one entry a block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecast.llm.splitting import spans, split_words
from lodecast.llm.token_counts import balanced, release

#: Words that are passed to the tokenizer as one text.
JOINED = 2000
#: Text bytes of a block of packed rows, about. A task holds one block at a time, so this bounds its memory.
BLOCK_BYTES = 3 << 20


def buckets_for(spark: SparkSession) -> int:
    """Word buckets of a run: one for each shuffle partition, which the user sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(items: pa.Array) -> bytes:
    """A binary array as one compressed value."""
    offsets = np.frombuffer(items.buffers()[1], np.int64, len(items) + 1, items.offset * 8)
    data = items.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    plain = np.int64(len(items)).tobytes() + np.diff(offsets).astype("<u4").tobytes() + raw
    return np.int64(len(plain)).tobytes() + pa.Codec("zstd", compression_level=6).compress(plain, asbytes=True)


def unpack(value: bytes) -> pa.Array:
    plain = pa.decompress(value[8:], int(np.frombuffer(value, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(plain, "<u4", n, 8), dtype=np.int64)])
    return spans(np.frombuffer(plain, np.uint8, offset=8 + 4 * n), offsets)


def narrowed(ids: pa.Array) -> pa.Array:
    """32-bit ids of words as 16-bit ones, where the vocabulary allows it."""
    offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
    flat = np.frombuffer(ids.buffers()[2], "<u4")[offsets[0] // 4 : offsets[-1] // 4]
    return spans(np.frombuffer(flat.astype("<u2").tobytes(), np.uint8), (offsets - offsets[0]) // 2)


def widened(ids: pa.Array) -> pa.Array:
    offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
    flat = np.frombuffer(ids.buffers()[2], "<u2")[offsets[0] // 2 : offsets[-1] // 2]
    return spans(np.frombuffer(flat.astype("<u4").tobytes(), np.uint8), (offsets - offsets[0]) * 2)


def word_buckets(words: pa.Array, n: int) -> np.ndarray:
    """A bucket for each word from a polynomial of all its bytes, so that words of one length or beginning spread too."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    lengths = np.diff(offsets)
    mixed = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[some] - offsets[0]
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(raw)) - np.repeat(starts, lengths[some])
        mixed[some] = np.add.reduceat((raw + np.uint64(1)) * powers[place], starts)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(n)).astype(np.int32)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file and, if it has special tokens, the text and id of one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    special = [(i, t.content) for i, t in found.get_added_tokens_decoder().items() if t.special]
    return found, (max(special) if special else None)


def encode_words(words: pa.Array, path: str) -> pa.Array:
    """The ids of each word, as little-endian unsigned 32-bit integers.

    Many words are passed as one text with a special token between them; the
    tokenizer handles what lies between special tokens independently. Words
    that may hold a special token themselves are encoded alone.
    """
    model, special = tokenizer(path)
    texts = [w.decode() for w in words.to_pylist()]
    parts: list[np.ndarray | None] = [None] * len(texts)
    plain = [i for i, t in enumerate(texts) if special and "<|" not in t]
    for start in range(0, len(plain), JOINED):
        own = plain[start : start + JOINED]
        ids = model.encode_batch_fast([special[1].join([texts[i] for i in own])], add_special_tokens=False)[0].ids
        flat = np.array(ids, "<u4")
        ends = np.append(np.flatnonzero(flat == special[0]), len(flat))
        begin = 0
        for i, end in zip(own, ends.tolist(), strict=True):
            parts[i] = flat[begin:end]
            begin = end + 1
    alone = [i for i, p in enumerate(parts) if p is None]
    for i, e in zip(alone, model.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
        parts[i] = np.array(e.ids, "<u4")
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return spans(np.frombuffer(flat.astype("<u4").tobytes(), np.uint8), np.concatenate([[0], np.cumsum(4 * sizes)]))


def in_order(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct words by bucket and then by bytes, and their buckets in that order.

    Both sides of the exchange derive this order from the words alone, so the
    answers need not carry them.
    """
    order = np.asarray(pc.sort_indices(words)).astype(np.int64)
    buckets = word_buckets(words, n)[order] if len(words) else np.zeros(0, np.int32)
    by_bucket = np.argsort(buckets, kind="stable")
    return order[by_bucket], buckets[by_bucket]


def joined_ids(column: pa.Array, ids: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a text column from its word table, and each row's offset into them."""
    own, first = split_words(column)
    if len(own) == 0:
        return np.zeros(0, "<u4"), np.zeros(len(first), np.int64)
    coded = own.dictionary_encode()
    order, _ = in_order(coded.dictionary, n_buckets)
    if len(order) != len(ids):
        raise ValueError("the word table does not have the words of the block")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = ids.take(pa.array(place[coded.indices.to_numpy()]))
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
    data = found.buffers()[2]
    flat = np.frombuffer(data, "<u4", int(offsets[-1]) // 4) if data is not None else np.zeros(0, "<u4")
    return flat, offsets[first] // 4


Assemble = Callable[[int, pa.Table, np.ndarray, np.ndarray], pa.Table]


def assemble_blocks(base: DataFrame, path: str, n_buckets: int, assemble: Assemble, schema: str, parts: Callable[[pa.Table], list[pa.Table]] = lambda rows: [rows]) -> DataFrame:
    """``assemble(block, rows, ids, offsets)`` over the blocks of ``base``.

    ``base`` has a column ``_block long`` and is partitioned by it. ``parts`` makes
    tables with a column ``_text`` from a block's rows; where it makes several, they
    are equal. ``ids[offsets[i]:offsets[i+1]]`` are the ids of row i of a part.
    """

    narrow = tokenizer(path)[0].get_vocab_size() <= 1 << 16

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        words = split_words(parts(table)[0].column("_text"))[0].unique()
        order, buckets = in_order(words, n_buckets)
        edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1)) if len(words) else np.zeros(1, np.int64)
        packed = [pack(words.take(pa.array(order[a:b]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        block = pa.array([key[0].as_py()] * len(packed), pa.int64())
        return pa.table({"_bucket": pa.array(buckets[edges[:-1]]), "_block": block, "_words": pa.array(packed, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [unpack(v) for v in table.column("_words").to_pylist()]
        coded = pa.concat_arrays(asked).dictionary_encode()
        ids = encode_words(coded.dictionary, path)
        packed, start = [], 0
        for words in asked:
            own = ids.take(coded.indices.slice(start, len(words)))
            packed.append(pack(narrowed(own) if narrow else own))
            start += len(words)
        del asked, coded, ids
        release()
        return table.select(["_bucket", "_block"]).append_column("_ids", pa.array(packed, pa.binary()))

    def join(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        none = spans(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        ids = pa.concat_arrays([none, *(unpack(v) for v in answers.sort_by("_bucket").column("_ids").to_pylist())])
        ids = widened(ids) if narrow else ids
        made = [assemble(key[0].as_py(), own, *joined_ids(own.column("_text"), ids, n_buckets)) for own in parts(rows)]
        del ids
        release()
        return pa.concat_tables(made)

    # Both groupings read the same columns of `base`, so that Spark shuffles it once.
    asked = base.groupBy("_block").applyInArrow(ask, "_bucket int, _block long, _words binary")
    answered = asked.groupBy("_bucket").applyInArrow(answer, "_bucket int, _block long, _ids binary")
    return base.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(join, schema)


def packed_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_block long, _rows binary``: neighbouring rows of a scan, packed and named by a hash of their content.

    Packed rows take about half the space of single ones in a shuffle. A name
    stands for its content, so a task that runs again cannot mix up two blocks.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for table in balanced(batches, "_text", block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.combine_chunks())
            data = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(data) - (1 << 63)], pa.int64()), pa.array([data], pa.binary())], names=["_block", "_rows"])

    return slim.mapInArrow(fold, "_block long, _rows binary").repartition(F.col("_block"))


def unfolded(rows: pa.Table) -> list[pa.Table]:
    """The packed rows of a block."""
    return [pa.ipc.open_stream(v).read_all().combine_chunks() for v in rows.column("_rows").to_pylist()]
