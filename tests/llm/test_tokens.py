"""BPE round trip, token counts and token files against the tokenizer libraries on whole texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import bag

tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def library(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizers.path(name))
    model.no_padding()
    model.no_truncation()
    return model


def test_bpe_round_trip(spark, docs, empty):
    from lodecast.llm.bpe import decode, encode, id_to_piece

    path = tokenizers.path("word_bpe_49k.json")
    model = library("word_bpe_49k.json")
    coded = encode(docs, path, block_bytes=50_000)
    assert coded.columns == ["doc_id", "ids"]
    found = decode(coded, id_to_piece(spark, path))
    expected = []
    for i, t in rows_of(docs):
        ids = model.encode(t, add_special_tokens=False).ids
        expected.append((i, np.array(ids, "<u4").tobytes(), model.decode(ids, skip_special_tokens=False)))
    assert bag((r[0], bytes(r[1]), r[2]) for r in found.collect()) == bag(expected)
    assert decode(encode(empty, path), id_to_piece(spark, path)).collect() == []


@pytest.mark.parametrize("batch_bytes", [200, 8 << 20])
def test_token_counts(docs, empty, batch_bytes):
    import sentencepiece

    from lodecast.llm.token_counts import count_tokens

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = count_tokens(docs, path, batch_bytes=batch_bytes)
    assert bag(found.collect()) == bag((i, len(t.encode()), len(model.encode(t))) for i, t in rows_of(docs))
    assert count_tokens(empty, path).collect() == []


def test_token_files(docs, empty):
    from lodecast.llm.files import read_file
    from lodecast.llm.wavelet import find_token, from_bytes, read_shards, write_shards

    path = tokenizers.path("byte_bpe_50k.json")
    model = library("byte_bpe_50k.json")
    expected, start = [], 0
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    stream = []
    for i, t in rows:
        ids = [*model.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    manifest = write_shards(docs, path, n_shards=3)
    found = read_shards(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long"), F.crc32("ids"))
    assert bag(found.collect()) == bag(expected)
    parts = [from_bytes(read_file(r["place"]))[0] for r in sorted(manifest.collect())]
    assert np.array_equal(np.concatenate([p.decode() for p in parts]), stream)
    matrix = parts[0]
    own = stream[: matrix.n]
    for value in {own[0], own[len(own) // 2], own[-1], 49999}:
        places = [k for k, v in enumerate(own) if v == value]
        assert matrix.count(value) == len(places)
        assert matrix.occurrences(value).tolist() == places
        assert matrix.rank(value, [0, len(own) // 3]).tolist() == [0, sum(v == value for v in own[: len(own) // 3])]
        assert matrix.select(value, [-1, len(places)]).tolist() == [-1, -1]
        # From all files, with the documents' ids.
        holders = [(i, [k for k, v in enumerate([*model.encode(t, add_special_tokens=False).ids, 0]) if v == value]) for i, t in rows]
        assert bag((r[0], r[1], tuple(r[2])) for r in find_token(manifest, value).collect()) == bag((i, len(p), tuple(p)) for i, p in holders if p)
    assert matrix.access(np.arange(matrix.n)).tolist() == own
    assert read_shards(write_shards(empty, path)).collect() == []


@pytest.mark.parametrize("make", [
    lambda r: np.zeros(0, np.uint32),
    lambda r: np.full(1500, 7, np.uint32),
    lambda r: np.array([3, 9], np.uint32),
    lambda r: r.integers(0, 300, 512).astype(np.uint32),
    lambda r: np.minimum(r.zipf(1.3, 40_000), 70_000).astype(np.uint32),
    lambda r: np.repeat(np.arange(20, dtype=np.uint32), 2 ** np.arange(20) // 16 + 1),
])
def test_wavelet_matrix(make):
    from lodecast.llm.wavelet import RANK_BITS, WaveletMatrix, from_bytes, to_bytes

    r = np.random.default_rng(5)
    values = make(r)
    r.shuffle(values)
    none = np.zeros(0, np.int64)
    matrix = from_bytes(to_bytes(WaveletMatrix.build(values), none, none.astype(bool), np.zeros(1, np.int64)))[0]
    assert np.array_equal(matrix.decode(), values)
    at = r.integers(0, max(1, len(values)), 300)[: len(values)]
    assert np.array_equal(matrix.access(at), values[at])
    for value in [*values[:3].tolist(), 80_000]:
        places = np.flatnonzero(values == value)
        assert np.array_equal(matrix.occurrences(value), places)
        assert np.array_equal(matrix.rank(value, at), np.searchsorted(places, at))
    # The planes hold the Huffman codes: at most a bit a value over the entropy, and padding.
    counts = np.unique(values, return_counts=True)[1]
    entropy = float(-(counts * np.log2(counts / max(1, len(values)))).sum())
    assert sum(matrix.sizes) <= entropy + len(values)
    assert sum(64 * len(p) for p in matrix.planes) <= sum(matrix.sizes) + RANK_BITS * len(matrix.planes)
