"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecast.llm.token_counts import balanced

#: Text bytes a task works on at a time.
BATCH_BYTES = 8 << 20
#: Characters before and after a span in which context words count, and what one adds or takes.
NEAR, RAISE, LOWER = 48, 0.2, 0.2
#: Spans of kinds outside the base are kept from this score.
KEPT_SCORE = 0.6
#: Kinds in the order in which spans with one start are listed.
BASE, MORE = ("email", "ip", "card", "phone"), ("iban", "national_id")

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        # No local part crosses an earlier "@", so each character is looked at once.
        before = text[max(floor, text.rfind("@", floor, at) + 1) : at]
        size = len(before) - len(before.rstrip(_LOCAL))
        if size:
            floor = m.end()
            yield at - size, floor


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed by mod 97; what fails is tried again without its last groups, as capitals may follow a code."""
    for m in _IBAN.finditer(text):
        code = m[0]
        while len(code.replace(" ", "")) >= 15:
            if mod97(code.replace(" ", "")):
                yield m.start(), m.start() + len(code)
                break
            code = code.rpartition(" ")[0]


def _nationals(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


@dataclass(frozen=True)
class Kind:
    find: Callable[[str], Iterator[tuple[int, int]]]
    #: What a text must hold, and the score of a proposed and confirmed span.
    needs: re.Pattern
    score: float
    context: re.Pattern
    against: re.Pattern


def _words(words: str) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(words.split())})\b", re.I)


_DIGIT = re.compile("[0-9]")
_NUMBER_WORDS = "id order invoice version serial isbn part build"
KINDS = {
    "email": Kind(_emails, re.compile("@"), 0.8, _words("mail email contact write correo courriel kontakt"), _words("example test")),
    "ip": Kind(_ips, _DIGIT, 0.7, _words("ip host address server login client"), _words("version release build section")),
    "card": Kind(_cards, _DIGIT, 0.8, _words("card visa mastercard credit karte tarjeta carte pay"), _words(_NUMBER_WORDS)),
    "phone": Kind(_phones, re.compile(r"\+"), 0.7, _words("phone tel call mobile fax telefon teléfono téléphone"), _words(_NUMBER_WORDS)),
    "iban": Kind(_ibans, _DIGIT, 0.7, _words("iban bank account konto cuenta compte transfer"), _words("key token secret " + _NUMBER_WORDS)),
    "national_id": Kind(_nationals, re.compile("-"), 0.4, _words("ssn social security national tax identity"), _words(_NUMBER_WORDS)),
}


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start and then kind; offsets in code points."""
    found = []
    for place, (name, kind) in enumerate(KINDS.items()):
        if not kind.needs.search(text):
            continue
        for start, end in kind.find(text):
            near = f"{text[max(0, start - NEAR) : start]}\n{text[end : end + NEAR]}"
            score = kind.score + RAISE * bool(kind.context.search(near)) - LOWER * bool(kind.against.search(near))
            score = round(min(1.0, max(0.0, score)), 3)
            if name in BASE or score >= KEPT_SCORE:
                found.append((start, place, name, end, score))
    return [(name, start, end, score) for start, _, name, end, score in sorted(found)]


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with a mark of the kind in place of each span; of overlapping spans the first is named."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<kind, start, end, score>>)`` for every row of ``docs``.

    Email, ip, card and phone spans are always kept, whatever their score;
    bank account numbers and national ids from ``KEPT_SCORE`` on. Null texts count
    as empty; null ids and repeated rows are kept as they come; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = slim.drop("_text").schema.add("spans", T.ArrayType(span))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, "_text", BATCH_BYTES):
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in table.column("_text").to_pylist()]
            yield from pa.table({"_id": table.column("_id"), "spans": pa.array(spans, kind)}).combine_chunks().to_batches()

    return slim.mapInArrow(find, schema).withColumnRenamed("_id", id_col)


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text_col`` masked; columns and rows stay, and null texts stay null."""
    names = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, text_col, BATCH_BYTES):
            texts = [t if t is None else masked(t, find_spans(t)) for t in table.column(text_col).to_pylist()]
            at = names.index(text_col)
            yield from table.set_column(at, text_col, pa.array(texts, pa.string())).combine_chunks().to_batches()

    return docs.mapInArrow(mask, docs.schema)
