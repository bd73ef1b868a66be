"""Splitting Arrow text batches at boundaries that no tokenizer piece crosses.

A cut is placed only where both neighbouring bytes prove that every supported
pre-tokenizer breaks there, so encoding the parts one by one and joining the
ids equals encoding the whole text.  All functions work on whole Arrow arrays
with numpy; nothing loops over characters or occurrences in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Byte classes. A "sure" letter is an ASCII letter or digit, or a character
# from U+00C0 to U+024F other than the two arithmetic signs in that range and
# the dotted capital I, whose lower case ends in a combining mark.
SPACE, PUNCT, LETTER, OTHER, DOUBTFUL, CONT = 1, 2, 3, 4, 5, 6
WORD_MARK = "\u2581".encode()
#: Last bytes that a non-ASCII white-space character can have in UTF-8.
_SPACE_ENDS = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])


def _class_table() -> bytes:
    table = bytearray([OTHER] * 256)
    for code in range(128):
        char = chr(code)
        if code == 32 or 9 <= code <= 13:
            table[code] = SPACE
        elif char.isalnum():
            table[code] = LETTER
        elif 33 <= code < 127 and char != "'":
            table[code] = PUNCT
    for code in range(0x80, 0xC0):
        table[code] = CONT
    for code in range(0xC3, 0xCA):
        table[code] = LETTER
    return bytes(table)


def _pair_table(spaces_only: bool) -> bytes:
    """1 where a cut is safe between a byte of class p and one of class q (index 8 p + q)."""
    table = bytearray(256)
    for before in (PUNCT, LETTER, OTHER):
        table[8 * before + SPACE] = 1
    if not spaces_only:
        table[8 * LETTER + PUNCT] = 1
        table[8 * PUNCT + LETTER] = 1
    return bytes(table)


_CLASSES, _CUTS, _SPACE_CUTS = _class_table(), _pair_table(False), _pair_table(True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the row offsets into them. Nulls count as empty."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Byte runs ``raw[offsets[i]:offsets[i+1]]`` as an Arrow array without a copy."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)]
    )


def split_words(column: pa.Array, atomic: bytes = b"<|") -> tuple[pa.Array, np.ndarray]:
    """Words of all rows in order, and for each row the index of its first word.

    A word is a run of white space with what follows up to the next safe cut, so
    the words of a row joined again are the row. Rows that contain ``atomic``
    (the start of a special token) are cut at white space only.
    Returns (words, first) with ``first[i]:first[i+1]`` the words of row i; an
    empty row has none.
    """
    raw, offs = flat(column)
    if len(raw) == 0:
        return spans(raw, np.zeros(1, np.int64)), np.zeros(len(offs), np.int64)
    kinds = np.frombuffer(raw.tobytes().translate(_CLASSES), np.uint8).copy()
    cont = np.flatnonzero(kinds == CONT)
    if len(cont):
        before, own = raw[cont - 1], raw[cont]
        letter = (before >= 0xC3) & (before <= 0xC9)
        sign = (before == 0xC3) & ((own == 0x97) | (own == 0xB7)) | (before == 0xC4) & (own == 0xB0)
        narrow = (before > 0xC9) & (before <= 0xDF)
        kinds[cont] = np.where(letter & ~sign, LETTER, np.where(~letter & ~narrow & _SPACE_ENDS[own], DOUBTFUL, OTHER))
        kinds[cont[sign] - 1] = OTHER
    pair = np.zeros(len(raw), np.uint8)
    np.left_shift(kinds[:-1], 3, out=pair[1:])
    pair[1:] |= kinds[1:]
    packed = pair.tobytes()
    cut = np.frombuffer(packed.translate(_CUTS), np.uint8).copy()
    whole = raw.tobytes()
    at = whole.find(atomic) if atomic else -1
    if at >= 0:
        bare = np.frombuffer(packed.translate(_SPACE_CUTS), np.uint8)
        while at >= 0:
            row = int(np.searchsorted(offs, at, "right")) - 1
            cut[offs[row] : offs[row + 1]] = bare[offs[row] : offs[row + 1]]
            at = whole.find(atomic, int(offs[row + 1]))
    starts = offs[:-1]
    cut[starts[starts < len(raw)]] = 1
    where = np.flatnonzero(cut)
    words = spans(raw, np.append(where, len(raw)))
    return words, np.searchsorted(where, offs)


def split_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Like split_words for sentencepiece models whose pieces never hold an inner word mark.

    Each row gets one space in front (the model's own dummy prefix) and is cut
    before each space that follows a non-space and before each newline, but not
    after the word mark U+2581, which is a space to the model, nor between the
    added space and a newline. A part that starts with the space is encoded
    without it, as the model adds its own; a part that starts with a newline has
    one token more than it brings, and a lone inner space is one token.
    """
    raw, offs = flat(column)
    n = len(offs) - 1
    out = np.empty(len(raw) + n, np.uint8)
    moved = offs + np.arange(n + 1)
    body = np.ones(len(out), bool)
    body[moved[:-1]] = False
    out[body] = raw
    out[moved[:-1]] = 32
    if n == 0:
        return spans(out, np.zeros(1, np.int64)), np.zeros(1, np.int64)
    cut = out == 10
    cut[1:] |= (out[1:] == 32) & (out[:-1] != 32)
    second = moved[:-1] + 1
    cut[second[second < len(out)]] = False
    whole = out.tobytes()
    at = whole.find(WORD_MARK)
    while at >= 0:
        if at + 3 < len(out) and out[at + 3] == 32:
            cut[at + 3] = False
        at = whole.find(WORD_MARK, at + 3)
    cut[moved[:-1]] = True
    where = np.flatnonzero(cut)
    return spans(out, np.append(where, len(out))), np.searchsorted(where, moved)
