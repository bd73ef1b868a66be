"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

Archives come as one gzip stream over the whole file, which can only be read from
its start. The normaliser inflates such a stream once, in chunks, writes every
record again as a gzip member of its own, and beside it an index with the
offset and length of each member, so that records can be read one by one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm.files import delete_file, exists, opened, read_file, shared_folder, stream_to, write_file, written
from lodecast.llm.token_counts import balanced

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
_CHUNK = 1 << 20
_EPOCH = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: int | None, url: str | None, kind: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has the HTTP header of its page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {url}')}>", f"WARC-Date: {_EPOCH}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []
    head += [f"X-Page-ID: {page}"] if page is not None else []
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}"] + ([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    """Header fields up to the first empty line, names in lower case."""
    lines = data.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed archive that comes in chunks; one record is held at a time."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                # Line ends between records are no part of either.
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if bytes(held).strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of one gzip stream, or of several in a row."""
    unzip = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield unzip.decompress(chunk, 4 * _CHUNK)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, 4 * _CHUNK)
            chunk = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def member(data: bytes) -> bytes:
    zipper = zlib.compressobj(4, zlib.DEFLATED, 31)
    return zipper.compress(data) + zipper.flush()


def _in_chunks(file) -> Iterator[bytes]:
    while chunk := file.read(_CHUNK):
        yield chunk


def normalise_file(source: str, target: str, remove_source: bool = False) -> None:
    """Rewrites an archive with a gzip member for each record; the index is ``target`` + ".index".

    The index is written last, so where it is present the archive is whole, and a
    task that runs again has nothing to do.
    """
    if not exists(f"{target}.index"):
        lines, at = [], 0
        with opened(source) as file, stream_to(target) as out:
            for found in records(inflated(_in_chunks(file))):
                data = member(found)
                out.write(data)
                fields = headers(found)
                lines.append(json.dumps({"offset": at, "length": len(data), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "page": fields.get("x-page-id")}))
                at += len(data)
        write_file(f"{target}.index", "\n".join(lines).encode())
    if remove_source:
        delete_file(source)


def read_members(place: str) -> Iterator[bytes]:
    """All records of a normalised archive, each inflated alone at its offset in the index."""
    lines = read_file(f"{place}.index").splitlines()
    with opened(place) as file:
        for line in lines:
            at = json.loads(line)
            file.seek(at["offset"])
            yield zlib.decompress(file.read(at["length"]), 31)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record for each page into archives of one gzip stream each; ``(place string)`` for each archive.

    The payload is the html in UTF-8; null counts as empty. Of pages with equal
    payloads of ``REVISIT_BYTES`` or more, that with the smallest id is the
    response and the others revisit it; repeated rows with that id are all
    responses. A null id counts as larger than all others; where all of a group
    are null, they are all responses. Of other columns nothing is kept.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    digests = slim.select("_id", F.sha2(F.col("_html").cast("binary"), 256).alias("_digest"), F.octet_length("_html").alias("_size")).where(f"_size >= {REVISIT_BYTES}")
    first = digests.groupBy("_digest").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).where("_n > 1").select("_digest", "_first")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for table in balanced(batches, "_html", 8 * _CHUNK):
            payloads = table.column("_html").cast(pa.binary()).to_pylist()
            columns = [table.column("_id"), table.column("_url"), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([codec.compress(p, asbytes=True) for p in payloads], pa.binary())]
            yield from pa.Table.from_arrays(columns, names=["_id", "_url", "_digest", "_size", "_packed"]).to_batches()

    # Payloads are shuffled compressed; the join's skewed keys can be split, as every row has one match at most.
    packed = slim.mapInArrow(pack, "_id long, _url string, _digest string, _size long, _packed binary")
    joined = packed.join(first, "_digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = f"{folder}/source-{uuid.uuid4().hex}.warc.gz"
        zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
        some = False
        with stream_to(place) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    some = True
                    first = row["_first"]
                    kind = "response" if first is None or first == row["_id"] else "revisit"
                    payload = pa.decompress(row["_packed"], row["_size"], codec="zstd", asbytes=True) if kind == "response" and row["_size"] else b""
                    out.write(zipper.compress(record(row["_id"], row["_url"], kind, row["_digest"], row["_size"], payload, first)))
            out.write(zipper.flush())
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([place])], names=["place"])
        else:
            delete_file(place)

    return written(joined.mapInArrow(write, "place string"), "warc-sources")


def _each_file(frame: DataFrame, run: Callable[[str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run(place)`` for the files of a frame, spread over all tasks by name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column("place").to_pylist():
                yield from run(place)

    n = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frame.select("place").repartition(n, "place").mapInArrow(work, schema)


def normalise_archives(sources: DataFrame, remove_sources: bool = False) -> DataFrame:
    """``(place string)`` of the normalised archives, which lie beside their sources with an index each."""

    def run(source: str) -> Iterator[pa.RecordBatch]:
        target = f"{source.removesuffix('.warc.gz')}.members.warc.gz"
        normalise_file(source, target, remove_sources)
        yield pa.RecordBatch.from_arrays([pa.array([target])], names=["place"])

    return written(_each_file(sources, run, "place string"), "warc-archives")


def read_archives(archives: DataFrame, id_col: str = "page_id", with_payload: bool = True) -> DataFrame:
    """``(id_col, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of all records.

    A response's payload is measured and its digest checked against the header; a
    revisit's figures are those of the payload it stands for. An archive without
    its index or a payload with another digest is an error.
    """
    names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def parsed(data: bytes) -> tuple:
        fields = headers(data)
        block = data.split(b"\r\n\r\n", 1)[1][: int(fields["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(headers(http)["content-length"])
        if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("a payload does not have its digest")
        page, refers = (int(v) if (v := fields.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
        found = (page, fields.get("warc-target-uri"), size, digest, fields["warc-type"], refers)
        return (*found, payload if fields["warc-type"] == "response" else None) if with_payload else found

    def run(place: str) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for data in read_members(place):
            rows.append(parsed(data))
            held += len(data) if with_payload else 200
            if held > 4 * _CHUNK:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = f"{id_col} long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return _each_file(archives, run, schema)
