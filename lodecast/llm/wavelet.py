"""Token-ID output: one compressed wavelet matrix file per shard.

The ids of a shard get Huffman codes, and the bits of the codes are stored as
planes: the first bits of all ids, then, after a stable split by that bit, the
second bits, and so on. Codes are dealt so that in each split the ids whose code
ends come last; they leave the sequence, and the next plane is shorter. So the
planes together have as many bits as the codes. With a count of ones per block of
bits, every plane answers rank in one step and select by bisection: tokens are
read, counted and located from the compressed file without decoding it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecast.llm.files import read_file, shared_folder, write_file
from lodecast.llm.word_table import assemble_blocks, buckets_for

MAGIC = b"WVLT0002"
#: A shard holds about so many units, a document being one and one more for every so many bytes: 8000 short documents or 32 MB of long
#: ones. There are at least as many shards as shuffle partitions.
SHARD_UNITS, UNIT_BYTES = 8000, 4096
#: Bits that share one stored count of ones, and their 64-bit words.
RANK_BITS, RANK_WORDS = 512, 8
#: Ids are below this; vocabularies are far smaller.
ID_LIMIT = 1 << 24
#: Occurrences that are located at a time.
LOCATED = 4096


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of values that occur ``counts`` times each; a lone value has one bit."""
    k = len(counts)
    if k < 2:
        return np.ones(k, np.uint8)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].tolist()
    above = [0] * (2 * k - 1)
    leaf, inner = 0, k
    for new in range(k, 2 * k - 1):
        total = 0
        for _ in range(2):
            if leaf < k and (inner == new or weights[leaf] <= weights[inner]):
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            above[least] = new
            total += weights[least]
        weights.append(total)
    depth = np.zeros(2 * k - 1, np.uint8)
    for node in range(2 * k - 3, -1, -1):
        depth[node] = depth[above[node]] + 1
    lengths = np.empty(k, np.uint8)
    lengths[order] = depth[:k]
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The codes of values with these lengths, as numbers of ``max(lengths)`` bits, the first bit highest.

    Of the prefixes of a length, in the order in which splitting leaves them, the last
    ones are codes and the others go on.
    """
    most = int(lengths.max(initial=0))
    codes = np.zeros(len(lengths), np.uint64)
    open_ = np.zeros(1, np.uint64)
    for length in range(1, most + 1):
        open_ = np.concatenate([2 * open_, 2 * open_ + np.uint64(1)])
        own = np.flatnonzero(lengths == length)
        going = len(open_) - len(own)
        codes[own] = open_[going:] << np.uint64(most - length)
        open_ = open_[:going]
    return codes


@dataclass
class WaveletMatrix:
    """``n`` values as planes of code bits.

    ``values`` are the distinct ones, ascending, with code ``lengths``. Plane k has
    ``sizes[k]`` bits, ``zeros[k]`` of them zero, in words of 64, lowest bit first, padded to
    whole blocks; ``counts[k]`` are the ones before each block.
    """

    n: int
    values: np.ndarray
    lengths: np.ndarray
    sizes: list[int]
    zeros: list[int]
    planes: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def build(cls, sequence: np.ndarray) -> WaveletMatrix:
        if len(sequence) and int(sequence.max()) >= ID_LIMIT:
            raise ValueError(f"ids must be below {ID_LIMIT}")
        totals = np.bincount(sequence) if len(sequence) else np.zeros(0, np.int64)
        values = np.flatnonzero(totals)
        lengths = code_lengths(totals[values])
        most = int(lengths.max(initial=0))
        code = np.zeros(len(totals), np.uint32 if most <= 32 else np.uint64)
        code[values] = codes_of(lengths)
        rest = code[sequence]
        ended = np.bincount(lengths, totals[values], most + 1).astype(np.int64)
        sizes, zeros, planes, counts = [], [], [], []
        for plane in range(most):
            bit = (rest >> rest.dtype.type(most - 1 - plane) & rest.dtype.type(1)).astype(bool)
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            packed = np.zeros((len(rest) // RANK_BITS + 1) * RANK_BITS // 8, np.uint8)
            packed[: (len(rest) + 7) // 8] = np.packbits(bit, bitorder="little")
            sizes.append(len(rest))
            zeros.append(len(low))
            planes.append(packed.view("<u8"))
            counts.append(np.searchsorted(high, np.arange(0, len(rest) + 1, RANK_BITS)).astype("<u4"))
            rest = np.concatenate([rest.take(low), rest.take(high)])[: len(rest) - ended[plane + 1]]
        return cls(len(sequence), values.astype("<u4"), lengths, sizes, zeros, planes, counts)

    @cached_property
    def _bits(self) -> np.ndarray:
        """The bits of the codes: a row for each distinct value, a column for each plane."""
        codes, most = codes_of(self.lengths), len(self.planes)
        return (codes[:, None] >> np.arange(most - 1, -1, -1, dtype=np.uint64)[None, :] & np.uint64(1)).astype(bool)

    def _ones(self, plane: int, ends: np.ndarray) -> np.ndarray:
        """Ones of a plane before each of some positions."""
        block = ends // RANK_BITS
        words = self.planes[plane].reshape(-1, RANK_WORDS)[block]
        inside = np.clip((ends % RANK_BITS)[:, None] - 64 * np.arange(RANK_WORDS), 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1))
        return self.counts[plane][block].astype(np.int64) + np.bitwise_count(words & mask).sum(1, dtype=np.int64)

    def _down(self, plane: int, positions: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where positions of a plane lie after the split, on the side of ``bit``."""
        ones = self._ones(plane, positions)
        return np.where(bit, self.zeros[plane] + ones, positions - ones)

    @cached_property
    def _totals(self) -> np.ndarray:
        """Occurrences of each distinct value."""
        first, last = np.zeros(len(self.values), np.int64), np.full(len(self.values), self.n, np.int64)
        for plane in range(len(self.planes)):
            own = np.flatnonzero(self.lengths > plane)
            bit = self._bits[own, plane]
            first[own], last[own] = self._down(plane, first[own], bit), self._down(plane, last[own], bit)
        return last - first

    def _ended(self, plane: int) -> np.ndarray:
        """The places in ``values`` of those whose code ends with a plane; they follow the next plane's sequence in this order."""
        return np.flatnonzero(self.lengths == plane + 1)

    def _size_after(self, plane: int) -> int:
        return self.sizes[plane + 1] if plane + 1 < len(self.sizes) else 0

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        at = np.asarray(positions, np.int64)
        found, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
        for plane in range(len(self.planes)):
            bit = (self.planes[plane][at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            at = self._down(plane, at, bit)
            after, own = self._size_after(plane), self._ended(plane)
            done = at >= after
            edges = np.cumsum(self._totals[own])
            found[open_[done]] = self.values[own[np.searchsorted(edges, at[done] - after, "right")]]
            at, open_ = at[~done], open_[~done]
        return found

    def _place(self, value: int) -> int | None:
        k = int(np.searchsorted(self.values, value))
        return k if k < len(self.values) and self.values[k] == value else None

    def _path(self, k: int, positions: np.ndarray) -> np.ndarray:
        for plane in range(int(self.lengths[k])):
            positions = self._down(plane, positions, self._bits[k, plane])
        return positions

    def rank(self, value: int, ends: np.ndarray) -> np.ndarray:
        """Occurrences of a value before each of some positions."""
        ends, k = np.asarray(ends, np.int64), self._place(value)
        return np.zeros(len(ends), np.int64) if k is None else self._path(k, ends) - self._path(k, np.zeros(1, np.int64))

    def count(self, value: int) -> int:
        return int(self.rank(value, np.array([self.n]))[0])

    def select(self, value: int, which: np.ndarray) -> np.ndarray:
        """Positions of the occurrences of a value with these numbers, from 0; -1 where there are fewer."""
        which, k = np.asarray(which, np.int64), self._place(value)
        out = np.full(len(which), -1, np.int64)
        if k is None:
            return out
        there = np.flatnonzero((which >= 0) & (which < self.count(value)))
        at = int(self._path(k, np.zeros(1, np.int64))[0]) + which[there]
        for plane in range(int(self.lengths[k]) - 1, -1, -1):
            bit = bool(self._bits[k, plane])
            before = self.counts[plane].astype(np.int64)
            if bit:
                at = at - self.zeros[plane]
            else:
                before = np.arange(len(before)) * RANK_BITS - before
            block = np.searchsorted(before, at, "right") - 1
            own = np.unpackbits(self.planes[plane].reshape(-1, RANK_WORDS)[block].view(np.uint8), axis=1, bitorder="little").astype(bool) == bit
            inside = (np.cumsum(own, 1, dtype=np.int16) > (at - before[block])[:, None]).argmax(1)
            at = block * RANK_BITS + inside
        out[there] = at
        return out

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of a value, ascending."""
        n = self.count(value)
        return np.concatenate([np.zeros(0, np.int64), *(self.select(value, np.arange(k, min(n, k + LOCATED))) for k in range(0, n, LOCATED))])

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        kind = np.uint16 if int(self.values.max(initial=0)) < 1 << 16 else np.uint32
        rest, values = np.zeros(0, kind), self.values.astype(kind)
        for plane in range(len(self.planes) - 1, -1, -1):
            own = self._ended(plane)
            after = np.concatenate([rest, np.repeat(values[own], self._totals[own])])
            bit = np.unpackbits(self.planes[plane].view(np.uint8), count=self.sizes[plane], bitorder="little").view(bool)
            rest = np.empty(self.sizes[plane], kind)
            rest[np.flatnonzero(~bit)] = after[: self.zeros[plane]]
            rest[np.flatnonzero(bit)] = after[self.zeros[plane] :]
        return rest


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray) -> bytes:
    """The file: magic, header size, JSON header, document ids, their validity, starts, values and code lengths, then counts and planes."""
    header = json.dumps({"n": matrix.n, "sizes": matrix.sizes, "zeros": matrix.zeros, "values": len(matrix.values), "docs": len(doc_ids), "rank_bits": RANK_BITS}).encode()
    parts = [MAGIC, struct.pack("<I", len(header)), header, doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), starts.astype("<i8").tobytes()]
    parts += [matrix.values.tobytes(), matrix.lengths.tobytes()]
    for counts, plane in zip(matrix.counts, matrix.planes, strict=True):
        parts += [counts.tobytes(), plane.tobytes()]
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, document ids, their validity and starts of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = struct.unpack_from("<I", data, 8)[0]
    h = json.loads(data[12 : 12 + size])
    at = 12 + size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    ids, known, starts = take("<i8", h["docs"]), take("u1", h["docs"]), take("<i8", h["docs"] + 1)
    values, lengths = take("<u4", h["values"]), take("u1", h["values"])
    counts, planes = [], []
    for bits in h["sizes"]:
        counts.append(take("<u4", bits // RANK_BITS + 1))
        planes.append(take("<u8", (bits // RANK_BITS + 1) * RANK_WORDS))
    return WaveletMatrix(h["n"], values, lengths, h["sizes"], h["zeros"], planes, counts), ids, known.astype(bool), starts


def _ordered_blocks(docs: DataFrame, id_col: str, text_col: str, least: int, n_shards: int | None) -> DataFrame:
    """``_block, _id, _text`` with blocks of about as many bytes each, ascending by id; null ids come first.

    A row counts for one unit and one more for every UNIT_BYTES of its text, and blocks are cut at quantiles of units: about SHARD_UNITS
    in each, whatever the lengths. Null ids, which any number of rows can share, are dealt over as many blocks by their texts' hashes.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    units = (1 + F.octet_length("_text") / UNIT_BYTES).cast("int")
    sized = slim.select("_id", units.alias("_units"))
    total = sized.agg(F.sum("_units").alias("all"), F.sum(F.when(F.col("_id").isNull(), F.col("_units"))).alias("none")).first()
    n = n_shards or max(least, -(-(total["all"] or 0) // SHARD_UNITS))
    # Ids alone, as often as they have units.
    weighted = sized.where("_id IS NOT NULL").select(F.explode(F.array_repeat("_id", F.col("_units"))).alias("_id"))
    at = [i / n for i in range(1, n)]
    bounds = np.array(weighted.approxQuantile("_id", at, 0.2 / n) if at else [], float)
    nulls = max(1, round(n * (total["none"] or 0) / max(1, total["all"] or 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("_id").cast(pa.float64(), safe=False).fill_null(0))
            known = np.asarray(batch.column("_id").is_valid())
            # The hash falls into ranges, and null ids lie before all others.
            hashed = np.asarray(batch.column("_hash")).astype(float) / 2.0**64 + 0.5
            block = np.where(known, nulls + np.searchsorted(bounds, ids, "right"), np.minimum((hashed * nulls).astype(np.int64), nulls - 1))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), batch.column("_id"), batch.column("_text")], names=["_block", "_id", "_text"])

    return slim.withColumn("_hash", F.xxhash64("_text")).mapInArrow(place, "_block long, _id long, _text string").repartition(F.col("_block"))


def write_shards(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, folder: str | None = None
) -> DataFrame:
    """Encodes, appends ``end_id`` to each text and writes one file per shard, ascending by id.

    Returns the manifest ``(shard int, place string, n_docs long, n_tokens long)``,
    written to the shared folder, so the files are made exactly once. Null texts
    count as empty (only the end id); null ids come first; equal ids are ordered
    by text (null ones by ranges of the texts' hashes, then by text), and equal rows are all kept; an empty table writes no file.
    Ids must be below ``ID_LIMIT``, and document ids must be whole numbers that a long holds. A shard holds about ``SHARD_UNITS`` units of
    text (see ``_ordered_blocks``), rows of one id together but for null ids, which are dealt over shards by their texts' hashes; it must fit in a worker's memory.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-shards")
    base = _ordered_blocks(docs, id_col, text_col, buckets_for(spark), n_shards)

    def shard(block: int, rows: pa.Table, ids: np.ndarray, offsets: np.ndarray) -> pa.Table:
        order = pa.compute.sort_indices(rows.select(["_id", "_text"]), sort_keys=[("_id", "ascending"), ("_text", "ascending")], null_placement="at_start").to_numpy()
        sizes = np.diff(offsets)[order]
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        values = np.full(int(starts[-1]), end_id, np.uint32)
        for place, row in enumerate(order.tolist()):
            values[starts[place] : starts[place + 1] - 1] = ids[offsets[row] : offsets[row + 1]]
        column = rows.column("_id").combine_chunks()
        known = np.asarray(column.is_valid())[order]
        name = f"{folder}/shard-{block:07d}.wm"
        write_file(name, to_bytes(WaveletMatrix.build(values), np.asarray(column.fill_null(0))[order], known, starts))
        return pa.table({"shard": pa.array([block], pa.int32()), "place": [name], "n_docs": pa.array([len(order)], pa.int64()), "n_tokens": pa.array([len(values)], pa.int64())})

    manifest = assemble_blocks(base, tokenizer_path, buckets_for(spark), shard, "shard int, place string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _from_files(manifest: DataFrame, read, schema: str) -> DataFrame:
    """Rows that ``read`` makes of each file's matrix, ids (an Arrow array), starts in the file and number of ids in all files before it."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each file: the running sum needs one task, over far fewer rows than documents.
    placed = manifest.select("shard", "place", F.coalesce(before, F.lit(0)).alias("first"))
    n = max(1, buckets_for(manifest.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, first in zip(batch.column("place").to_pylist(), batch.column("first").to_pylist(), strict=True):
                matrix, ids, known, starts = from_bytes(read_file(place))
                yield read(matrix, pa.array(ids, mask=~known), starts, first)

    return placed.repartition(n, "shard").mapInArrow(run, schema)


def read_shards(manifest: DataFrame, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start long, ids binary, n_ends long)`` of all documents, read from the files of a manifest.

    ``start`` counts the ids of all documents before it; ids are little-endian
    unsigned 32-bit integers with the end id. ``n_ends`` counts the end id in the
    document, by rank at its borders: more than one where the text holds it too.
    """

    def read(matrix: WaveletMatrix, ids: pa.Array, starts: np.ndarray, first: int) -> pa.RecordBatch:
        data = matrix.decode().astype("<u4").tobytes()
        values = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(4 * np.ascontiguousarray(starts)), pa.py_buffer(data)])
        ends = pa.array(np.diff(matrix.rank(end_id, starts)))
        return pa.RecordBatch.from_arrays([ids, pa.array(starts[:-1] + first), values.cast(pa.binary()), ends], names=[id_col, "start", "ids", "n_ends"])

    return _from_files(manifest, read, f"{id_col} long, start long, ids binary, n_ends long")


def find_token(manifest: DataFrame, value: int, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_found long, places array<long>)`` of the documents that hold an id, from the files without decoding them.

    Documents are chosen by rank at their borders, places (from 0 in the document,
    ascending) found by select. The end id counts as any other; a value that does
    not occur gives no rows.
    """

    def read(matrix: WaveletMatrix, ids: pa.Array, starts: np.ndarray, first: int) -> pa.RecordBatch:
        counts = np.diff(matrix.rank(value, starts))
        own = np.flatnonzero(counts)
        places = matrix.occurrences(value) - np.repeat(starts[:-1], counts)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts[own])]).astype(np.int32), pa.array(places, pa.int64()))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(counts[own]), lists], names=[id_col, "n_found", "places"])

    return _from_files(manifest, read, f"{id_col} long, n_found long, places array<long>")
