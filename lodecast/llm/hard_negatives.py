"""Hard negatives of anchors by an exact inner-product search over buckets of equal label and near norm.

Vectors are made integer, sorted by label and falling norm (dealt by ranges, so a
hot label has many tasks) and cut into buckets that know their greatest norm.
Anchors, a stated query set, go in blocks; each block reads bucket after bucket,
greatest norms first. No product exceeds the anchor's norm times the bucket's
(Cauchy-Schwarz), so a bucket is left out, and with it all after it, where that
is under the lower limit of every window of the block or under the running kth
score. Only a block, a bucket and the best so far are in memory; blocks are
independent and read written files, so a lost task is run again by itself.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecast.llm.files import opened, shared_folder, stream_to

#: Rows of a bucket, and anchors that search together: both bound a task's memory, not its result.
BUCKET_ROWS, BLOCK_ROWS = 2048, 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW_PERCENT, HIGH_PERCENT = 30, 90
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256) -> DataFrame:
    """``_id, _label, _v, _norm``: components as floor(scale * x), the label as text, the Euclidean norm.

    Rows with a null id, label or vector, or with a null, NaN or infinite component, are left out. Vectors may differ in length: missing
    components are zeros. Components beyond a long are cut to its range.
    """
    label = F.col(label) if isinstance(label, str) else label
    whole = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    fit = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    told = fit.select(F.col(id_col).cast("long").alias("_id"), label.cast("string").alias("_label"), v.alias("_v")).where("_label IS NOT NULL")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return told.withColumn("_norm", norm)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as a matrix, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def write_buckets(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS) -> list[str]:
    """Writes bucket files to the shared folder and returns their places, one for each partition that has rows.

    A file holds its buckets one after the other and then their list: label, greatest norm, place in the file.
    """
    folder = shared_folder(vectors.sparkSession, "norm-buckets")
    sorted_ = vectors.repartitionByRange("_label", F.col("_norm").desc(), "_id").sortWithinPartitions("_label", F.col("_norm").desc(), "_id")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, float, np.ndarray, np.ndarray]]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            labels = left["_label"].combine_chunks().dictionary_encode()
            codes = labels.indices.to_numpy()
            start = 0
            edges = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for k, edge in enumerate(edges):
                last = k == len(edges) - 1  # its label may go on in the next batch
                while edge - start >= bucket_rows or (start < edge and not last):
                    part = left.slice(start, min(bucket_rows, edge - start))
                    yield _bucket(part)
                    start += len(part)
            left = left.slice(start)
        if left is not None and len(left):
            yield _bucket(left)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        place, listed = f"{folder}/{uuid.uuid4().hex}", []
        found = buckets(b for b in batches if b.num_rows)
        first = next(found, None)
        if first is None:
            return
        with stream_to(place) as out:
            at, bucket = 0, first
            while bucket is not None:
                label, top, ids, v = bucket
                data = ids.tobytes() + v.tobytes()
                out.write(data)
                listed.append({"label": label, "top": top, "at": at, "size": len(data), "rows": len(ids), "type": v.dtype.str})
                at, bucket = at + len(data), next(found, None)
            footer = json.dumps(listed).encode()
            out.write(footer + len(footer).to_bytes(8, "little"))
        yield pa.RecordBatch.from_pydict({"place": [place]})

    return [row.place for row in sorted_.mapInArrow(write, "place string").collect()]


def _bucket(part: pa.Table) -> tuple[str, float, np.ndarray, np.ndarray]:
    v = _matrix(part["_v"])
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    return part["_label"][0].as_py(), part["_norm"][0].as_py(), part["_id"].to_numpy().astype(np.int64), v.astype(kind)


@lru_cache(maxsize=4)
def _listed(places: tuple[str, ...]) -> list[dict]:
    """All buckets of the files, greatest norms first."""
    found = []
    for place in places:
        with opened(place) as file:
            end = file.size() - 8
            file.seek(end)
            size = int.from_bytes(file.read(8), "little")
            file.seek(end - size)
            found += [b | {"place": place} for b in json.loads(file.read(size))]
    return sorted(found, key=lambda b: -b["top"])


def _read(bucket: dict) -> tuple[np.ndarray, np.ndarray]:
    with opened(bucket["place"]) as file:
        file.seek(bucket["at"])
        data = file.read(bucket["size"])
    n = bucket["rows"]
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.dtype(bucket["type"]), offset=8 * n).reshape(n, -1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of both, as doubles where these are exact, else as longs cut to their range."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    if most[0] * most[1] * max(1, width) < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    exact = a.astype(object) @ b.T.astype(object) if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Best:
    """The ``k`` best of each of ``n`` searches: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), _LEAST), np.full((n, k), _MOST)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(at)
        at = np.concatenate([at, np.repeat(touched, self.k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kept = rank < self.k
        self.scores[at[kept], rank[kept]], self.ids[at[kept], rank[kept]] = scores[kept], ids[kept]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, inside: np.ndarray) -> None:
        """Adds those of a matrix (searches ``rows`` by ``ids``) that are inside and may be among the best."""
        inside = inside & (scores >= self.scores[rows, -1][:, None])
        if inside.sum() > 4 * self.k * len(rows) and scores.shape[1] > self.k:
            own = np.where(inside, scores, _LEAST)
            inside &= scores >= np.partition(own, -self.k, axis=1)[:, -self.k][:, None]
        r, c = np.nonzero(inside)
        if len(r):
            self.add(rows[r], scores[r, c].astype(np.int64), ids[c])


def search(ids: np.ndarray, labels: list[str], v: np.ndarray, norms: np.ndarray, places: tuple[str, ...], positives: int, negatives: int, read=_read) -> dict[str, list]:
    """Positives of a block of anchors, then the negatives of each positive's window; rows with the anchor's own id are neither."""
    listed = _listed(places)
    reach = norms * (1 + 1e-9)
    near, own = Best(len(ids), positives), np.array(labels)
    for label in sorted(set(labels)):
        rows = np.flatnonzero(own == label)
        for bucket in (b for b in listed if b["label"] == label):
            open_ = rows[reach[rows] * bucket["top"] >= near.scores[rows, -1].astype(float)]
            if not len(open_):
                break
            other, w = read(bucket)
            near.offer(open_, inner_products(v[open_], w), other, ids[open_][:, None] != other[None])
    found = near.ids != _MOST
    # Whole limits: 30 p <= 100 s <= 90 p is ceil(0.3 p) <= s <= floor(0.9 p).
    low = np.array([[-(-LOW_PERCENT * int(s) // 100) for s in row] for row in near.scores], object)
    high = np.array([[HIGH_PERCENT * int(s) // 100 for s in row] for row in near.scores], object)
    possible = found & (low <= high)
    low, high = (np.clip(np.where(possible, x, 0), _LEAST, _MOST).astype(np.int64) for x in (low, high))
    hard = Best(len(ids) * positives, negatives)
    window = np.arange(len(ids) * positives).reshape(len(ids), positives)
    for bucket in listed:
        least = np.maximum(low, hard.scores[:, -1].reshape(window.shape))  # the running kth score, or the lower limit
        open_ = possible & (reach[:, None] * bucket["top"] >= least.astype(float))
        if not open_.any():
            break
        rows = np.flatnonzero(open_.any(1) & (own != bucket["label"]))
        if not len(rows):
            continue
        other, w = read(bucket)
        scores = inner_products(v[rows], w)
        apart = ids[rows][:, None] != other[None]
        for j in range(positives):
            at = np.flatnonzero(open_[rows, j])
            if len(at):
                mine = scores[at]
                inside = (mine >= least[rows[at], j][:, None]) & (mine <= high[rows[at], j][:, None]) & apart[at]
                if inside.any():
                    hard.offer(window[rows[at], j], mine, other, inside)
    told = np.argwhere(hard.ids.reshape(len(ids), positives, negatives) != _MOST)
    a, j, r = told.T
    return {
        "anchor_id": ids[a], "positive_id": near.ids[a, j], "rank": (r + 1).astype(np.int32), "negative_id": hard.ids[window[a, j], r],
        "positive_score": near.scores[a, j], "negative_score": hard.scores[window[a, j], r],
    }


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and each of its positives.

    Both tables are of ``integer_vectors``. An anchor's positives are the ``positives`` rows of its label with the highest
    scores; negatives are the first ``negatives`` rows of other labels whose scores lie in the positive's window. Ties go to the smaller
    id. Repeated rows count as often as they come, and a repeated anchor is answered as often. Windows of negative
    positives are empty; anchors without positives or negatives, and empty tables, give no rows.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    places = tuple(sorted(write_buckets(vectors, bucket_rows)))
    context = anchors.sparkSession.sparkContext
    blocks = max(1, math.ceil(anchors.count() / block_rows), 2 * context.defaultParallelism)
    # Blocks of one label and near norms have tight limits; a hot label has many blocks.
    dealt = anchors.repartitionByRange(blocks, "_label", "_norm", "_id").sortWithinPartitions("_label", "_norm", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                found = search(part["_id"].to_numpy().astype(np.int64), part["_label"].to_pylist(), _matrix(part["_v"]), part["_norm"].to_numpy(), places, positives, negatives)
                yield pa.RecordBatch.from_pydict(found)

    return dealt.mapInArrow(run, schema)
