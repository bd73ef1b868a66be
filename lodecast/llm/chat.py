"""Chat records of any known layout as canonical turns, a reversible template with a loss mask, and digests read back from it.

A layout is known by its fingerprint, a hash of the nested field paths of a record. For each fingerprint a declarative mapping says where roles and
texts lie. Records can be JSON texts, each with its own layout, or rows of a table, whose schema has one layout. Turns stay rows:
no conversation is gathered in a list, and each turn is formatted and parsed by itself, in Spark's own functions. Only
the digests need a conversation's turns one after the other: rows dealt by ranges of (conversation, turn) are joined to
longer parts where they lie, and what is then streamed by conversation, in order, is those few parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from lodecast.llm.files import written

#: Bytes of neighbouring turns that are joined to one part before the digests.
PART_BYTES = 1 << 18


# ---------------------------------------------------------------- layouts

@dataclass(frozen=True)
class Said:
    """One turn of a record: a fixed role (``role``) or the path of one (``role_path``), and the path of its text.

    Turns without a text are left out if they are ``optional``.
    """

    text_path: str
    role: str | None = None
    role_path: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    """A name, the field paths that its fingerprint hashes, and the mapping: turns of a record, or a list of turns at ``list_path``.

    Paths of fields join names by dots; a list is ``[]``. In a list, the turn's paths
    are relative to its elements. Names of roles are replaced by ``roles``.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[Said, ...]
    list_path: str | None = None
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatgpt", "assistant"))

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def shape_of(paths: tuple[str, ...] | list[str]) -> str:
    """Nested field paths as one text, fields in the order of their names, such as ``OBJECT<messages: ARRAY<OBJECT<content: , role: >>>``."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def told(node: dict) -> str:
        parts = []
        for name in sorted(node, key=lambda n: n.removesuffix("[]")):
            own = told(node[name]) if node[name] else ""
            parts.append(f"{name.removesuffix('[]')}: " + (f"ARRAY<{own}>" if name.endswith("[]") else own))
        return f"OBJECT<{', '.join(parts)}>"

    return told(tree)


def fingerprint_of(paths: tuple[str, ...] | list[str]) -> str:
    """The hash by which a layout is known: 16 hex digits of the SHA-256 of its nested field paths."""
    return hashlib.sha256(shape_of(paths).encode()).hexdigest()[:16]


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), (Said("text", role_path="role"),)),
    Layout("messages", ("messages[].content", "messages[].role"), (Said("content", role_path="role"),), "messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (Said("value", role_path="from"),), "conversations"),
    Layout("conversations with system", ("conversations[].from", "conversations[].value", "system"), (Said("system", "system", optional=True), Said("value", role_path="from")), "conversations"),
    Layout("prompt and completion", ("completion", "prompt"), (Said("prompt", "user"), Said("completion", "assistant"))),
    Layout("prompt and response", ("prompt", "response"), (Said("prompt", "user"), Said("response", "assistant"))),
    Layout("system, prompt and response", ("prompt", "response", "system"), (Said("system", "system", optional=True), Said("prompt", "user"), Said("response", "assistant"))),
    Layout("instruction and output", ("instruction", "output"), (Said("instruction", "user"), Said("output", "assistant"))),
    Layout("instruction, input and output", ("input", "instruction", "output"), (Said("instruction", "user"), Said("input", "user", optional=True), Said("output", "assistant"))),
    Layout("question and answer", ("answer", "question"), (Said("question", "user"), Said("answer", "assistant"))),
    Layout("nested chosen", ("chosen[].content", "chosen[].role", "prompt"), (Said("content", role_path="role"),), "chosen"),
)


def schema_paths(schema: DataType, before: str = "") -> list[str]:
    """Nested field paths of a table's schema, leaves only."""
    if isinstance(schema, StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name)]
    if isinstance(schema, ArrayType):
        return schema_paths(schema.elementType, f"{before}[]")
    return [before]


#: Types of leaves in Spark's text of a record's schema, such as OBJECT<prompt: STRING, turns: ARRAY<BIGINT>>.
_LEAVES = r"(?<=[:<] ?)(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|UUID|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\d+\))(?=[,>])"


def with_fingerprints(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``records`` with ``_v``, the parsed record, and its ``fingerprint`` and ``layout``.

    The fingerprint hashes the names of all nested fields, whatever their values; a field with a null has its path
    too. The layout of a record that no mapping knows is null; a text that is no JSON has no fingerprint either. Top-level fields
    named in ``ignored``, such as an id, may be there or not.
    """
    known = {}
    for one in layouts:
        for n in range(len(ignored) + 1):
            for more in combinations(ignored, n):
                known[fingerprint_of((*one.paths, *more))] = one.name
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    told = records.withColumn("_v", F.try_parse_json(json_col))
    shape = F.regexp_replace(F.schema_of_variant("_v"), _LEAVES, "")
    told = told.withColumn("fingerprint", F.substring(F.sha2(shape.cast("binary"), 256), 1, 16))
    return told.withColumn("layout", F.element_at(names, F.col("fingerprint")))


def _role(said: Said, layout: Layout, found: Column | None) -> Column:
    if said.role is not None:
        return F.lit(said.role)
    names = F.create_map(*(F.lit(x) for pair in layout.roles for x in pair))
    return F.coalesce(F.element_at(names, found), found, F.lit(""))


def _element(said: Said, layout: Layout):
    """The function that makes a turn of a list's element."""

    def turn(e: Column) -> Column:
        role = _role(said, layout, F.try_variant_get(e, f"$.{said.role_path}", "string"))
        return F.struct(role.alias("role"), F.coalesce(F.try_variant_get(e, f"$.{said.text_path}", "string"), F.lit("")).alias("text"))

    return turn


def turns_of_records(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS, ignored: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``id, turn, role, text`` of all records whose layout is known, and ``id, fingerprint`` of the others, so that none is lost unseen.

    Turns count from 0. A null text is empty, a null role is the empty one. Records are read once for
    their layouts: the mapping is chosen row by row.
    """
    told = with_fingerprints(records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("_json")), "_json", layouts, ignored)
    lists = F.lit(None)
    for one in layouts:
        single = [s for s in one.turns if one.list_path is None or s.text_path == "system"]
        several = [s for s in one.turns if s not in single]
        parts = []
        for s in single:
            text = F.try_variant_get("_v", f"$.{s.text_path}", "string")
            role = _role(s, one, F.try_variant_get("_v", f"$.{s.role_path}", "string") if s.role_path else None)
            turn = F.array(F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text")))
            parts.append(F.when(text.isNotNull() & (text != ""), turn).otherwise(F.filter(turn, lambda _: F.lit(False))) if s.optional else turn)
        for s in several:
            held = F.try_variant_get("_v", f"$.{one.list_path}", "array<variant>")
            parts.append(F.transform(held, _element(s, one)))
        lists = F.when(F.col("layout") == one.name, F.concat(*parts)).otherwise(lists)
    turns = told.select("conv_id", F.posexplode(lists).alias("turn", "_t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")
    return turns, told.where("layout IS NULL").select("conv_id", "fingerprint")


def turns_of_rows(rows: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, role, text`` of a table that has one row for each turn; its schema's fingerprint chooses the mapping.

    Columns that no layout of rows names, whatever they are called, are ignored. Turns are in the order of ``turn``.
    """
    for one in layouts:
        if one.list_path is None and set(one.paths) <= {f.name for f in rows.schema} and "turn" in one.paths:
            kept = rows.select(*one.paths)
            if fingerprint_of(schema_paths(kept.schema)) == one.fingerprint:
                said = one.turns[0]
                role = _role(said, one, F.col(said.role_path).cast("string")) if one.roles and said.role_path else F.lit(said.role)
                return rows.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(said.text_path).cast("string"), F.lit("")).alias("text"))
    raise ValueError(f"no layout of turn rows for {fingerprint_of(schema_paths(rows.schema))}: {schema_paths(rows.schema)}")


# ---------------------------------------------------------------- template

#: Strings that tokenizers of chat models read as control, of this template and of others.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<unk>", "<pad>")
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    r"""The text with ``\`` doubled and a ``\`` after the first character of every control string, so that none is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:  # none begins with another's end, so breaking one leaves and makes no other
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    r"""What ``escaped`` was given: the first of each pair of ``\``, and every single one, goes."""
    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda part: F.replace(part, F.lit("\\"), F.lit(""))), "\\")


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id, turn, piece, loss_start, loss_end``: each turn as the template writes it, and the part of it under the loss mask.

    A piece is start mark, role, line break, text, end mark; a conversation is its pieces
    one after the other. Offsets are code points within the piece, end exclusive; both are null where nothing is learned. Line breaks in
    roles are escaped as ``\\n`` (no control string has n as its second character).
    """
    role = F.replace(escaped(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    text = escaped(F.coalesce(F.col("text"), F.lit("")))
    told = turns.select("conv_id", "turn", F.col("role").isin(*loss_roles).alias("_loss"), F.concat(F.lit(START), role, F.lit(BREAK)).alias("_head"), text.alias("_text"))
    start = F.when(F.col("_loss"), F.char_length("_head"))
    return told.select("conv_id", "turn", F.concat("_head", "_text", F.lit(END)).alias("piece"), start.cast("long").alias("loss_start"), (start + F.char_length("_text")).cast("long").alias("loss_end"))


def parsed(pieces: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, learned, piece_chars`` read back from pieces and their masks alone; ``learned`` is null where no loss is."""
    inner = F.expr(f"substring(piece, {len(START) + 1}, char_length(piece) - {len(START) + len(END)})")
    split = pieces.select("conv_id", "turn", "loss_start", "loss_end", "piece", inner.alias("_inner"), F.char_length("piece").cast("long").alias("piece_chars"))
    at = F.locate("\n", F.col("_inner"))
    # In roles, an escaped line break is a single backslash and n; pairs of backslashes are parted first.
    role = F.array_join(F.transform(F.split(F.expr("substring_index(_inner, '\n', 1)"), r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")
    learned = F.expr("CASE WHEN loss_start IS NOT NULL THEN substring(piece, int(loss_start) + 1, int(loss_end - loss_start)) END")
    return split.select("conv_id", "turn", role.alias("role"), unescaped(F.substring(F.col("_inner"), at + 1, F.lit(2**31 - 1))).alias("text"), unescaped(learned).alias("learned"), "piece_chars")


# ---------------------------------------------------------------- digests

def digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of ``parsed`` turns.

    The first digest is of role, line break, text, line break of all turns, the second of the learned texts, in the order of turn, then of
    role and text where turns repeat (null turns first). A null id is a conversation like any other.
    """
    listed = read.select(
        "conv_id", "turn", "role", "text", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("_said"), F.coalesce("learned", F.lit("")).alias("_learned"), "piece_chars")
    order = ["conv_id", "turn", "role", "text"]
    # Ranges part even one conversation, and equal rows lie together in any order.
    dealt = listed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    parts = written(dealt.select("conv_id", "_range", "_said", "_learned", "piece_chars").mapInArrow(_joined, "conv_id long, _range int, _seq long, _n long, _said binary, _learned binary, loss_chars long, formatted_chars long"), "chat-parts")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "_range", "_seq")
    return ordered.mapInArrow(_hashed, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring turns of one conversation as one row, up to PART_BYTES."""
    seq, held = 0, None
    out: list[dict] = []
    size = 0
    for batch in batches:
        for conv, range_, said, learned, chars in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held is not None and (held["conv_id"] != conv or held["_bytes"] >= PART_BYTES):
                out.append(held)
                size += held["_bytes"]
                held = None
                if size >= 4 * PART_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            if held is None:
                held = {"conv_id": conv, "_range": range_, "_seq": seq, "_n": 0, "_said": [], "_learned": [], "loss_chars": 0, "formatted_chars": 0, "_bytes": 0}
                seq += 1
            held["_n"] += 1
            held["_said"].append(said.encode())
            held["_learned"].append(learned.encode())
            held["loss_chars"] += len(learned)
            held["formatted_chars"] += chars
            held["_bytes"] += len(said) + len(learned)
    if held is not None:
        out.append(held)
    if out:
        yield _batch(out)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "_range": pa.int32(), "_seq": pa.int64(), "_n": pa.int64(), "_said": pa.binary(), "_learned": pa.binary(), "loss_chars": pa.int64(), "formatted_chars": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([b"".join(r[n]) if k == pa.binary() else r[n] for r in rows], k) for n, k in kinds.items()], names=list(kinds))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its parts in order; a conversation's text is never held whole."""
    now, told = None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def finished(t):
        return t[0], t[1], t[2].hexdigest(), t[3], t[4].hexdigest(), t[5]

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if told is None or now != r["conv_id"]:
                if told is not None:
                    done.append(finished(told))
                now, told = r["conv_id"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            told[1] += r["_n"]
            told[2].update(r["_said"])
            told[3] += r["loss_chars"]
            told[4].update(r["_learned"])
            told[5] += r["formatted_chars"]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if told is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(finished(told), kinds, strict=True)], names=names)
