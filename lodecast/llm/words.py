"""Word hashes and n-gram hashes of whole Arrow text batches, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from lodecast.llm.splitting import flat, spans

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def byte_set(separators: list[int]) -> np.ndarray:
    """True for bytes that belong to words, given the ASCII codes that do not."""
    table = np.ones(256, bool)
    table[separators] = False
    return table


#: Words are runs of anything but ASCII white space.
NOT_SPACE = byte_set([0x20, *range(0x09, 0x0E)])


def word_spans(column: pa.Array, inside: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows in order as binary values, and the index of each row's first word (one more at the end).

    ``inside`` tells word bytes from separators; bytes of non-ASCII characters
    must all be inside. ``lower`` maps A-Z to a-z first. Null rows have no words.
    """
    raw, offs = flat(column)
    if len(raw) == 0:
        return spans(raw, np.zeros(1, np.int64)), np.zeros(len(offs), np.int64)
    if lower:
        upper = (raw >= 65) & (raw <= 90)
        raw = np.where(upper, raw + 32, raw).astype(np.uint8)
    mask = inside[raw]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    rows = offs[:-1]
    rows = rows[rows < len(raw)]
    begins[rows] = mask[rows]
    where = np.flatnonzero(begins)
    packed = raw[mask]
    starts = np.flatnonzero(begins[mask])
    return spans(packed, np.append(starts, len(packed))), np.searchsorted(where, offs)


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word is hashed once."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()]


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring word hashes (rows are not told apart)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(n))
    for j in range(n):
        total = total * _FACTOR + words[j : j + count]
    return mix(total)
