"""Benchmark decontamination by winnowing.

Both sides keep, of every run of WINDOW - GRAM + 1 neighbouring word grams, those
with the least hash. A span of WINDOW words that both sides share has the same
least gram on both, so joining the kept grams misses no such span. Each hit is
extended to the windows around it, and those are compared word by word.

The benchmark becomes index files in the shared folder, each of bounded size.
Every task loads them one at a time and joins its documents' fingerprints with
each, so neither side is shuffled and no hash can be hot, however large the
benchmark is.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecast.llm.files import read_file, shared_folder, write_file
from lodecast.llm.token_counts import balanced
from lodecast.llm.words import byte_set, hashed, ngram_hashes, word_spans

#: Words of a window, and of the grams whose hashes are kept.
WINDOW, GRAM = 10, 5
#: Benchmark text bytes of one index file, about, and text bytes a task works on at a time.
INDEX_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
INSIDE = byte_set([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_BITS = 20


def kept_grams(codes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and whether each is least in a run of a row's window; all that tie are kept."""
    grams = ngram_hashes(codes, gram)
    span = window - gram + 1
    n = len(codes) - window + 1
    keep = np.zeros(len(grams), bool)
    if n <= 0:
        return grams, keep
    least = grams[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + n], out=least)
    valid = whole_windows(first, len(codes), window)
    for j in range(span):
        keep[j : j + n] |= valid & (grams[j : j + n] == least)
    return grams, keep


def whole_windows(first: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """For each word but the last ones, whether the window that starts there lies in one row."""
    n = n_words - window + 1
    ok = np.ones(max(n, 0), bool)
    for edge in np.unique(first[1:-1]).tolist():
        ok[max(0, edge - window + 1) : max(0, min(edge, n))] = False
    return ok


class Index:
    """Windows of benchmark items, by the hash of their words, and the fingerprints that lead to them."""

    def __init__(self, rows: pa.Table) -> None:
        words, first = word_spans(rows.column("_text"), INSIDE, lower=True)
        codes = hashed(words)
        texts = words.to_pylist()
        items = rows.column("_item").to_pylist()
        self.windows: dict[int, list[tuple[tuple[bytes, ...], set]]] = {}
        self.lengths: set[int] = set()
        prints = []
        for item, a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = min(WINDOW, b - a)
            if size == 0 or item is None:
                continue
            own = codes[a:b]
            if size == WINDOW:
                grams, keep = kept_grams(own, np.array([0, b - a]))
                prints.append(grams[keep])
            else:
                self.lengths.add(size)
            for k, code in enumerate(ngram_hashes(own, size).tolist()):
                content = tuple(texts[a + k : a + k + size])
                same = self.windows.setdefault(code, [])
                held = next((s for s in same if s[0] == content), None)
                if held is None:
                    same.append(held := (content, set()))
                held[1].add(item)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.codes = np.sort(np.fromiter(self.windows, np.uint64, len(self.windows)))
        self.filters = tuple(self._bits(v) for v in (self.prints, self.codes))

    @staticmethod
    def _bits(values: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return bits

    def _among(self, which: int, values: np.ndarray) -> np.ndarray:
        """Places of the values that are prints (0) or window codes (1)."""
        known = (self.prints, self.codes)[which]
        maybe = np.flatnonzero(self.filters[which][(values >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe) or not len(known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        return maybe[known[at] == values[maybe]]

    def occurrences(self, codes: np.ndarray, first: np.ndarray, words: pa.Array, grams: np.ndarray, keep: np.ndarray) -> list[tuple[int, int, set]]:
        """``(first word, number of words, item ids)`` of every window that occurs in a row."""
        starts: list[tuple[np.ndarray, np.ndarray, int]] = []
        places = np.flatnonzero(keep)
        hits = places[self._among(0, grams[places])]
        if len(hits):
            ok = whole_windows(first, len(codes), WINDOW)
            # A gram lies in the windows that start up to WINDOW - GRAM words before it.
            around = np.unique((hits[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            around = around[(around >= 0) & (around < len(ok))]
            around = around[ok[around]]
            if len(around):
                spread = np.concatenate([ngram_hashes(codes[p : p + WINDOW], WINDOW) for p in around.tolist()])
                found = self._among(1, spread)
                starts.append((around[found], spread[found], WINDOW))
        for size in sorted(self.lengths):
            every = ngram_hashes(codes, size)
            found = self._among(1, every)
            found = found[whole_windows(first, len(codes), size)[found]]
            starts.append((found, every[found], size))
        out = []
        for at, values, size in starts:
            for start, code in zip(at.tolist(), values.tolist(), strict=True):
                content = tuple(words.slice(start, size).to_pylist())
                out += [(start, size, ids) for text, ids in self.windows[code] if text == content]
        return out


@lru_cache(maxsize=1)
def _index(place: str) -> Index:
    return pickle.loads(read_file(place))


def write_index(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Writes the benchmark's index files to the shared folder; their places.

    Their number follows from the benchmark's size, so each stays under a bound
    unless one item alone is larger.
    """
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-int(total) // INDEX_BYTES))
    folder = shared_folder(benchmark.sparkSession, "benchmark-index")
    slim = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt = slim.withColumn("_file", F.pmod(F.xxhash64("_item", "_text"), F.lit(n)))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        place = f"{folder}/{key[0].as_py()}.index"
        write_file(place, pickle.dumps(Index(rows)))
        return pa.table({"place": [place]})

    # One row for each file.
    return sorted(r["place"] for r in dealt.groupBy("_file").applyInArrow(build, "place string").collect())


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items, spans, contaminated)`` for every row of ``docs``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond
    ASCII. A window is ``WINDOW`` neighbouring words of an item; an item of fewer,
    but not none, is one window. Document words inside an occurrence of a window
    are hit: ``spans`` has them as maximal runs [first word, number of words], and
    ``items`` the ids, as strings in their order, of the items whose windows occur.
    Null texts have no words; items with a null id are left out, and repeated items
    count once; null ids and repeated rows of ``docs`` are kept; other columns
    are ignored, whatever their names; empty tables give no hits.
    """
    places = write_index(benchmark, item_col, text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    span = T.StructType().add("first", "long").add("n", "long")
    schema = slim.drop("_text").schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long")
    schema = schema.add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(span))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, "_text", BATCH_BYTES):
            words, first = word_spans(table.column("_text"), INSIDE, lower=True)
            covered = np.zeros(len(words) + 1, np.int64)
            items: dict[int, set] = defaultdict(set)
            for start, size, ids in occurrences(places, words, first):
                covered[start] += 1
                covered[start + size] -= 1
                items[int(np.searchsorted(first, start, "right")) - 1] |= ids
            hit = np.cumsum(covered)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            spans = [runs(hit[a:b]) if n else [] for a, b, n in zip(first[:-1], first[1:], n_hit.tolist(), strict=True)]
            lists = [sorted(items.get(i, ())) for i in range(table.num_rows)]
            new = [np.diff(first), n_hit, [len(i) for i in lists]]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
            out = table.drop_columns(["_text"])
            for name, values in zip(("n_words", "n_hit", "n_items"), new, strict=True):
                out = out.append_column(name, pa.array(values, pa.int64()))
            out = out.append_column("items", pa.array(lists, pa.list_(pa.string()))).append_column("spans", pa.array(spans, kind))
            yield from out.combine_chunks().to_batches()

    found = slim.mapInArrow(hits, schema)
    return found.withColumnRenamed("_id", id_col).withColumn("contaminated", F.col("n_hit") > 0)


def without_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, all columns as they are.

    Rows are judged where they lie, so ids may be null or repeated.
    """
    places = write_index(benchmark)
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, text_col, BATCH_BYTES):
            hit = np.zeros(table.num_rows, bool)
            words, first = word_spans(table.column(text_col), INSIDE, lower=True)
            for start, _, _ in occurrences(places, words, first):
                hit[int(np.searchsorted(first, start, "right")) - 1] = True
            yield from table.select(names).filter(pa.array(~hit)).to_batches()

    return docs.mapInArrow(clean, docs.schema)


def occurrences(places: list[str], words: pa.Array, first: np.ndarray) -> Iterator[tuple[int, int, set]]:
    """Occurrences of all windows of the index files in the rows of a batch."""
    codes = hashed(words)
    grams, least = kept_grams(codes, first)
    for place in places:
        yield from _index(place).occurrences(codes, first, words, grams, least)


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": a, "n": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
