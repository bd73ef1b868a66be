"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Each distinct shingle set has a label in every tree: a sequence of MinHash values.
A tree is the sorted sequence of its labels, so that sets with a common prefix, the
nodes of the prefix trie, lie side by side; one pass over the sorted labels keeps
those that share a prefix with a neighbour. Pairs that share their whole label in
some tree are verified exactly first. Each link found at similarity s tells how many
like it met in no tree (lost / (1 - lost) with lost = (1 - s^length)^trees); while
that is not negligible, matched prefixes are shortened to the length at which the
links found let expect it to be, and the pairs that meet only there are verified
too. So the prefix length follows from the data, and a corpus of close copies ends
with long prefixes and few candidates.

Copies are represented by their set, so exact copies never meet in a node. A
node of many sets is dealt out in blocks, and each pair of blocks is one unit of
work; a pair of sets is verified only in the first tree where it meets. Sets
are sent only to the units that verify a pair of them. What leaves a unit are
link counts and a spanning forest of its verified links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodecast.llm.components import components
from lodecast.llm.files import written
from lodecast.llm.splitting import flat
from lodecast.llm.token_counts import balanced
from lodecast.llm.words import NOT_SPACE, hashed, ngram_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, values of a label, and the recall at the threshold at whose prefix length the sorted labels are kept.
TREES, DEPTH, RECALL = 32, 6, 1 - 1e-7
#: Bytes of a tree's label: the tree's number, then two bytes for each value.
_WIDTH = 2
#: Links between sets of the whole table that may be expected to be missed; prefixes are shortened until they are as few.
MISSED = 0.01
#: Sets and shingles of a block at most, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000
#: 64-bit words of the bit rows that are compared at a time.
BIT_WORDS = 1024
#: Values of so many sets of a unit at most are counted pair by pair.
RARE = 8
#: Text bytes a task works on at a time.
BATCH_BYTES = 4 << 20
#: Children of an element in a unit's spanning forest.
BRANCHES = 16
#: Bits of the filter that finds the texts of wanted sets: at most 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def matched_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The prefix length at which pairs at the threshold meet in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending in each row, and the row offsets.

    A row of fewer than ``n`` words has one shingle of all its words; one without words none.
    """
    words, first = word_spans(column, NOT_SPACE)
    codes = hashed(words)
    grams = ngram_hashes(codes, n)
    parts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            parts.append(own[keep])
        else:
            parts.append(ngram_hashes(codes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def tree_labels(shingles: np.ndarray, offsets: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each row that has shingles, its labels: in each tree its number and the low bytes of ``depth`` MinHash values."""
    seeds = np.random.default_rng(20_011).integers(1, 1 << 32, size=(trees, depth, 2), dtype=np.uint64).astype(np.uint32)
    starts = offsets[:-1][np.diff(offsets) > 0]
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    labels = np.empty((len(starts), trees, 1 + _WIDTH * depth), np.uint8)
    labels[:, :, 0] = np.arange(trees)
    for t in range(trees):
        for d in range(depth):
            least = np.minimum.reduceat(low * (seeds[t, d, 0] | np.uint32(1)) ^ seeds[t, d, 1], starts) if len(starts) else starts
            labels[:, t, 1 + _WIDTH * d : 1 + _WIDTH * (d + 1)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :_WIDTH]
    return labels


def _set_ids(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    import xxhash

    raw = shingles.tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, trees: int, depth: int) -> DataFrame:
    """``_id, _hash, _set, _size, _label``: id, hash of the text, its shingle set's id and size, and its labels in all trees, packed."""
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, "_text", BATCH_BYTES):
            shingles, offsets = shingle_sets(table.column("_text"), n)
            sizes = np.diff(offsets)
            found = iter(tree_labels(shingles, offsets, trees, depth))
            labels = pa.array([next(found).tobytes() if n else None for n in sizes.tolist()], pa.binary())
            columns = [table.column("_id"), table.column("_hash"), pa.array(_set_ids(shingles, offsets), pa.binary()), pa.array(sizes.astype(np.int32)), labels]
            yield from pa.Table.from_arrays(columns, names=["_id", "_hash", "_set", "_size", "_label"]).to_batches()

    return slim.mapInArrow(sign, f"_id {kind}, _hash long, _set binary, _size int, _label binary")


def tries(sets: DataFrame, trees: int, depth: int, level: int) -> DataFrame:
    """``_prefix, _set, _size``: the labels of all trees in order, those that share ``level`` values with a neighbour.

    The order has the set last, so that equal labels, too, are dealt out evenly. The
    first and the last label of a partition stay, as their neighbours lie elsewhere.
    """
    width, size = 1 + _WIDTH * depth, 1 + _WIDTH * level
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree")
    rows = sets.select("_set", "_size", "_label", each).select(F.substring("_label", F.col("_tree") * width + 1, F.lit(width)).alias("_prefix"), "_set", "_size")
    order = ["_prefix", "_set"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        own, stays = b"", True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            raw, offsets = flat(batch.column("_prefix"))
            heads = raw.reshape(-1, width)[:, :size]
            first = heads[0].tobytes()
            equal = (heads[1:] == heads[:-1]).all(1)
            left = np.concatenate([[held is None or own == first], equal])
            if held is not None and (stays or own == first):
                yield held
            keep = left | np.concatenate([equal, [False]])
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held, own, stays = batch.slice(batch.num_rows - 1), heads[-1].tobytes(), bool(left[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(shared, rows.schema)


def nodes_of(trees: int, depth: int, levels: list[int]) -> Column:
    """The keys of a set's nodes at the levels, tree by tree, from its labels."""
    width = 1 + _WIDTH * depth

    def at(level: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.substring("_label", t * width + 1, F.lit(1 + _WIDTH * level))))

    return F.concat(*map(at, levels))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with whole runs of equal keys, from batches sorted by them; one run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1] for k in keys]
            if last == [batch.column(k)[batch.num_rows - 1] for k in keys]:
                held.append(batch)
                continue
        start = batch.num_rows - 1
        ends = [batch.column(k)[start] for k in keys]
        while start > 0 and [batch.column(k)[start - 1] for k in keys] == ends:
            start -= 1
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif held:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


_UNIT = ["_key", "_i", "_j"]


def _units(table: pa.Table) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of each unit of a table sorted by unit."""
    columns = [np.asarray(table.column(k)) for k in _UNIT]
    new = np.zeros(table.num_rows, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), table.num_rows]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _matrix(table: pa.Table) -> np.ndarray:
    """The nodes of each row, one column for each tree."""
    lists = table.column("_keys").combine_chunks()
    return np.asarray(lists.flatten()).view(np.uint64).reshape(table.num_rows, -1)


def _sides(blocks: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides whose pairs the unit of blocks i and j has to verify; both are all rows if i is j."""
    return (np.arange(len(blocks)),) * 2 if i == j else (np.flatnonzero(blocks == i), np.flatnonzero(blocks == j))


def _first_met(keys: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.uint64, trees: int, same: bool) -> np.ndarray:
    """For each pair of the sides, once, whether this node is where it meets first: neither in an earlier tree nor under a longer prefix."""
    tree = int(np.flatnonzero((keys[:, :trees] == key).all(0))[0])
    met = np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
    left, right = np.ascontiguousarray(keys[a].T), np.ascontiguousarray(keys[b].T)
    for t in (*range(tree), *range(trees, keys.shape[1])):
        met &= left[t][:, None] != right[t][None, :]
    return met


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each sorted set of a with each of b (with later ones only, if b is a)."""
    same, n = a is b, len(a)
    out = np.zeros((n, len(b)), np.int32)
    if n * len(b) <= 4:
        for i in range(n):
            for j in range(i + 1 if same else 0, len(b)):
                out[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        return out
    sets = a if same else [*a, *b]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    values, rows, counts = inverse[order], rows[order], counts[inverse[order]]
    # Values of few sets: their pairs one by one.
    rare = (counts > 1) & (counts <= RARE)
    value, row = values[rare], rows[rare]
    for step in range(1, RARE):
        equal = np.flatnonzero(value[step:] == value[:-step]) if len(value) > step else np.zeros(0, np.int64)
        one, two = row[equal], row[equal + step] - (0 if same else n)
        apart = slice(None) if same else (one < n) & (two >= 0)
        out += np.bincount(one[apart] * len(b) + two[apart], minlength=n * len(b)).reshape(n, len(b)).astype(np.int32)
    # Values of many sets: a bit each.
    often = counts > RARE
    value, row = values[often], rows[often]
    at = np.cumsum(np.diff(value, prepend=-1) != 0) - 1
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, 64 * BIT_WORDS):
        here = (at >= start) & (at < start + 64 * BIT_WORDS)
        bit = at[here] - start
        words = np.zeros((len(sets), int(bit.max()) // 64 + 1), np.uint64)
        np.bitwise_or.at(words, (row[here], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        others = words if same else words[n:]
        for i in range(n):
            first = i + 1 if same else 0
            out[i, first:] += np.bitwise_count(words[i] & others[first:]).sum(1, dtype=np.int32)
    return out


def _plan(trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of units that have a pair to verify there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _UNIT):
            keys = _matrix(table)
            nodes = np.asarray(table.column("_key")).view(np.uint64)
            blocks, ii, jj = (np.asarray(table.column(c)) for c in ("_block", "_i", "_j"))
            keep = np.zeros(table.num_rows, bool)
            for first, last in _units(table):
                a, b = _sides(blocks[first:last], ii[first], jj[first])
                pairs = _first_met(keys[first:last], a, b, nodes[first], trees, ii[first] == jj[first])
                keep[first + a[pairs.any(1)]] = True
                keep[first + b[pairs.any(0)]] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return run


def _connected(pairs: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected component of a table of pairs (with its mirror image, if both sides are the same)."""
    left = pairs.any(1)
    while left.any():
        rows, columns, edge = np.zeros(pairs.shape[0], bool), np.zeros(pairs.shape[1], bool), np.zeros(pairs.shape[0], bool)
        edge[int(np.argmax(left))] = True
        while edge.any():
            rows |= edge
            new = pairs[edge].any(0) & ~columns
            columns |= new
            edge = pairs[:, new].any(1) & ~rows
        left &= ~(rows | columns) if same else ~rows
        yield rows, columns


def missed_for(similarities: np.ndarray, trees: int, level: int) -> float:
    """Links expected to have met in no tree, for links that were found: each stands for 1 / (probability of being found)."""
    lost = (1 - similarities**level) ** trees
    return float((lost / (1 - lost)).sum())


def _verify(threshold: float, trees: int, levels: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Link counts and a spanning forest of each unit's verified pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _UNIT):
            keys = _matrix(table)
            packed = table.column("_shingles").to_pylist()
            nodes = np.asarray(table.column("_key")).view(np.uint64)
            blocks, ii, jj, copies = (np.asarray(table.column(c)) for c in ("_block", "_i", "_j", "_copies"))
            rows: list[int] = []
            above: list[int] = []
            counts: list[int] = []
            estimates: list[list[float] | None] = []
            for first, last in _units(table):
                sets = [np.frombuffer(p, "<u8") for p in packed[first:last]]
                sizes, own = np.array([len(s) for s in sets]), copies[first:last]
                same = ii[first] == jj[first]
                a, b = _sides(blocks[first:last], ii[first], jj[first])
                one = [sets[k] for k in a]
                both = overlaps(one, one if same else [sets[k] for k in b])
                pairs = _first_met(keys[first:last], a, b, nodes[first], trees, same)
                pairs &= both >= threshold * (sizes[a][:, None] + sizes[b][None, :] - both) - 1e-9
                i, j = np.nonzero(pairs)
                near = both[i, j] / (sizes[a][i] + sizes[b][j] - both[i, j])
                missed = [missed_for(near, trees, k) for k in range(1, levels + 1)]
                links = np.zeros(last - first, np.int64)
                links[a] += pairs @ own[b]
                links[b] += own[a] @ pairs
                for in_a, in_b in _connected(pairs | pairs.T if same else pairs, same):
                    members = (first + np.union1d(a[in_a], b[in_b])).tolist()
                    rows += members
                    # Few children each, so that no set gets an edge from all others of its class.
                    above += [members[max(0, m - 1) // BRANCHES] for m in range(len(members))]
                    counts += links[np.array(members) - first].tolist()
                    # What the unit's links say of missed ones stands once.
                    estimates += [missed, *[None] * (len(members) - 1)]
                    missed = [0.0] * levels
            if rows:
                at, up = pa.array(rows), pa.array(above)
                columns = [table.column(c).take(n).combine_chunks() for n in (at, up) for c in ("_set", "_id", "_hash")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(estimates, pa.list_(pa.float64()))], schema=schema)

    return run


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` with the ``_text`` of its ``_id`` and ``_hash``.

    A bit map of the wanted hashes goes to all tasks first, so that only the texts
    it lets through are shuffled.
    """
    place = F.pmod(F.col("_hash"), F.lit(FILTER_BITS))
    # At most FILTER_BITS / 32768 rows of 4096 bytes.
    bits = wanted.select(place.alias("_at")).groupBy(F.expr("_at div 32768").alias("_slot")).agg(F.expr("bitmap_construct_agg(_at % 32768)").alias("_bits"))
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_own_hash"))
    at = texts.withColumn("_at", F.pmod(F.col("_own_hash"), F.lit(FILTER_BITS)))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_at % 32768 div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    near = at.join(F.broadcast(bits), F.expr("_at div 32768") == F.col("_slot")).where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    return near.select("_own", "_text", "_own_hash").join(wanted, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))).select(*wanted.columns, "_text")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, missed: float = MISSED
) -> DataFrame:
    """``(id_col, class_id, n_links long, _hash long, _class_hash long)`` for every row of ``docs``.

    Words are runs of anything but ASCII white space. Rows are linked if the
    Jaccard similarity of their sets of ``n`` neighbouring words is at least
    ``threshold``; a row with fewer words has one shingle of them all.
    ``n_links`` counts all other rows that a row is linked to, copies and repeated
    rows included; ``class_id`` is the least id of its connected component.
    ``_hash`` (xxhash64 of the text) tells rows of one id apart, and ``_class_hash`` is
    that of the class's first row: of the rows with its id, the least. Null and empty
    texts have no shingles and no links, and are classes of their own. A null id
    is no class id where the class has another; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    signed = written(signatures(docs, id_col, text_col, n, trees, depth), "forest-signatures")
    some = signed.where("_set IS NOT NULL")
    # Of a class, the row of the least id speaks, a null id last, and of several rows of one id that of the least hash.
    speaker = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")
    sets = written(some.groupBy("_set").agg(F.min(speaker).alias("_rep"), F.count("*").alias("_copies"), F.first("_size").alias("_size"), F.first("_label").alias("_label")), "forest-sets")
    kind = signed.schema["_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, "_text", BATCH_BYTES):
            shingles, offsets = shingle_sets(table.column("_text"), n)
            values = pa.array([shingles[a:b].astype("<u8").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield from table.drop_columns(["_text"]).append_column("_shingles", values).combine_chunks().to_batches()

    def grown(level: int) -> tuple[int, DataFrame, DataFrame]:
        """The tries of a level, and the sets that have a node of several sets there."""
        trie = written(tries(sets, trees, depth, level), "forest-tries")
        return level, trie, written(sets.join(trie.select("_set").distinct(), "_set", "left_semi").select("_set", "_label"), "forest-shared")

    def links_at(trie: DataFrame, shared: DataFrame, level: int, longer: int | None) -> DataFrame:
        """Verified links of the pairs that meet at a level, but not at the longer one that came before."""
        nodes = trie.select("_set", "_size", F.xxhash64(F.substring("_prefix", F.lit(1), F.lit(1 + _WIDTH * level))).alias("_key"))
        full = nodes.groupBy("_key").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum")).where("_n > 1")
        blocks = F.ceil(F.greatest(F.col("_n") / BLOCK_SETS, F.col("_sum") / BLOCK_SHINGLES)).cast("int")
        dealt = nodes.join(full.select("_key", blocks.alias("_blocks")), "_key").select("_key", "_set", "_blocks", F.pmod(F.xxhash64("_set"), F.col("_blocks")).cast("int").alias("_block"))
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
        units = dealt.select("_key", "_set", "_block", other).select("_key", "_set", "_block", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
        placed = shared.select("_set", nodes_of(trees, depth, [level, *([longer] if longer else [])]).alias("_keys"))
        keyed = units.join(placed, "_set").select(*_UNIT, "_block", "_set", "_keys")
        planned = written(keyed.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_plan(trees), keyed.schema), "forest-units")

        # The shingles of the sets that have a pair to verify, from one document each.
        wanted = planned.select("_set").distinct().join(sets, "_set").select("_set", "_rep._id", "_rep._hash", "_copies")
        wanted = written(wanted, "forest-wanted")
        met = texts_of(docs, wanted, id_col, text_col)
        known = met.mapInArrow(pack, f"_set binary, _id {kind}, _hash long, _copies long, _shingles binary").dropDuplicates(["_set"])
        sent = planned.join(known, "_set").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
        schema = f"_set binary, _id {kind}, _hash long, _up binary, _up_id {kind}, _up_hash long, _links long, _missed array<double>"
        arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
        return written(sent.mapInArrow(_verify(threshold, trees, depth, arrow), schema), "forest-links")

    level = depth
    floor, trie, shared = grown(matched_depth(threshold, trees, depth, recall))
    verified = links_at(trie, shared, level, None)
    while level > 1:
        lost = [v or 0.0 for v in verified.agg(*(F.sum(F.element_at("_missed", k)) for k in range(1, level + 1))).first()]
        if lost[level - 1] <= missed:
            break
        longer, level = level, next((k for k in range(level - 1, 0, -1) if lost[k - 1] <= missed), 1)
        if level < floor:
            floor, trie, shared = grown(level)
        verified = verified.unionByName(links_at(trie, shared, level, longer))

    def node(prefix: str) -> Column:
        return F.struct(F.col(f"{prefix}_id").isNull().alias("_none"), F.col(f"{prefix}_id").alias("_id"), F.col(f"{prefix}_hash").alias("_hash"), F.col(prefix or "_set").alias("_set"))

    # The least node of a component names it, so its label is the class.
    linked = components(verified.select(node("").alias("a"), node("_up").alias("b"))).select(F.col("node._set").alias("_of"), F.col("label").alias("_class"))
    counts = verified.groupBy("_set").agg(F.sum("_links").alias("_links"))
    named = sets.join(linked, F.col("_set") == F.col("_of"), "left").join(counts, "_set", "left")
    result = named.select(
        "_set",
        F.coalesce("_class._id", F.when(F.col("_class").isNull(), F.col("_rep._id"))).alias("class_id"),
        F.coalesce("_class._hash", "_rep._hash").alias("_class_hash"),
        (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
    )
    # Written first, so that nothing but the join itself needs a set's rows together, and Spark can split them.
    result = written(result, "forest-classes")
    rows = signed.select("_id", "_hash", "_set")
    found = rows.where("_set IS NOT NULL").join(result, "_set").select(F.col("_id").alias(id_col), "class_id", "n_links", "_hash", "_class_hash")
    alone = rows.where("_set IS NULL").select(F.col("_id").alias(id_col), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "_hash", F.col("_hash").alias("_class_hash"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class its first row.

    That is the one of the least id (a null id last) and, among rows of one id, the
    least hash of the text. Columns and rows without words stay as they are; of
    repeated rows one stays.
    """
    found = similar_classes(docs, id_col, text_col, **options)
    first = found.where(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("_hash") == F.col("_class_hash")))
    named = first.groupBy(F.col(id_col).alias("_own"), F.col("_hash").alias("_its")).agg(F.count("*").alias("_rows"))
    kept = written(named, "forest-kept")
    own = docs[id_col].eqNullSafe(kept["_own"]) & F.xxhash64(docs[text_col]).eqNullSafe(kept["_its"])
    if kept.where("_rows > 1").isEmpty():
        return docs.join(kept, own, "left_semi")
    single = docs.join(kept.where("_rows = 1"), own, "left_semi")
    return single.unionByName(docs.join(kept.where("_rows > 1"), own, "left_semi").dropDuplicates([id_col, text_col]))
