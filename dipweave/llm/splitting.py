"""Cutting oversized texts at natural boundaries into pieces within a limit, consecutive pieces sharing an overlap.

The boundaries of a text have strengths. For each piece, a sparse table gives the strongest boundary of the window of lengths that the piece may have, in constant
time; of equally strong ones the rightmost, so pieces are long. The next piece starts an overlap before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import n_tokens

#: Boundaries of a page in wiki markup, strongest first; a cut falls at the end of a match, but before a heading. The weakest are characters.
BOUNDARIES = [
    (8, re.compile(rb"\n(?=={2}[^=])")),
    (7, re.compile(rb"\n(?==+)")),
    (6, re.compile(rb"\n\s*\n")),
    (5, re.compile(rb"\n(?=\{\||\{\{)|(?<=\|\})\n|(?<=\}\})\n")),
    (4, re.compile(rb"\n(?:\|-[^\n]*\n)?")),
    (3, re.compile(rb"[.!?][\"')\]]*\s|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xd8\x9f\s|\xe0\xa5\xa4|</ref>")),
    (2, re.compile(rb"[;:,]\s|\xe3\x80\x81|\xef\xbc\x8c|\xd8\x8c\s")),
    (1, re.compile(rb"\s")),
]
#: Bytes whose boundaries are in one sparse table; a long text is looked at in such parts, one after the other.
PART = 1 << 18


def strengths(text: bytes) -> np.ndarray:
    """The strength of a cut before each byte of a text: 0 at a character's start, -1 within a character."""
    raw = np.frombuffer(text, np.uint8)
    out = np.where((raw & 0xC0) == 0x80, -1, 0).astype(np.int8)
    for strength, pattern in reversed(BOUNDARIES):
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        at = at[at < len(out)]
        out[at] = np.where(out[at] >= 0, strength, out[at])
    return out


class SparseTable:
    """Range maxima over strengths, the rightmost of equals."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        first = (values.astype(np.int64) << 40) + np.arange(len(values))
        self.levels, span = [first], 1
        while 2 * span <= min(longest, len(values)):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-span], below[span:]))
            span *= 2

    def best(self, low: int, high: int) -> int:
        """The place of the strongest value in [low, high)."""
        k = (high - low).bit_length() - 1
        return int(max(self.levels[k][low], self.levels[k][high - (1 << k)])) & ((1 << 40) - 1)


def cuts(text: bytes, limit: int, overlap: int, shortest: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text in bytes, by the rule of split_texts."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    # the reach of a pattern beyond a part, for matches that lie across its border
    reach, least = 64, max(overlap + 4, int(limit * shortest), 1)
    part = max(PART, 4 * limit)
    out, start, base, size, table = [], 0, -1, 0, None
    while n - start > limit:
        if base < 0 or start + limit + 1 > base + size:
            base, size = start, min(part, n - start)
            before = min(base, reach)
            table = SparseTable(strengths(text[base - before : base + size + reach])[before : before + size + 1], limit - least + 1)
        low, high = start + least, start + limit
        end = base + table.best(low - base, min(high - base + 1, len(table.levels[0])))
        if end <= start + overlap or text[end] & 0xC0 == 0x80:
            end = high
            while text[end] & 0xC0 == 0x80:
                end -= 1
        out.append((start, end))
        start = end - overlap
        while text[start] & 0xC0 == 0x80:
            start += 1
    return out + [(start, n)]


def split_texts(documents: DataFrame, limit: int = 4096, overlap: int = 128, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, end, tokens, text): the pieces, numbered from 0, of each text of documents with more tokens than the limit.

    A piece has at most limit tokens. It ends at the strongest boundary that makes it at least half the limit long, at the rightmost of equally strong ones; where there
    is none at all, at a character's end. The next piece starts `overlap` tokens before that end, or at the next character if that is within one, so the pieces
    cover the text and no piece splits a character. start and end are places in tokens. Texts within the limit, empty ones and
    NULL give no row. overlap must be less than half the limit, and the limit at least 16. Each row is cut by itself: repeated rows give repeated pieces, NULL keys stay NULL;
    further columns are left out.
    """
    if limit < 16 or not 0 <= overlap < limit // 2 - 4:
        raise ValueError("the limit must be at least 16 and the overlap less than half of it")
    long = documents.select(key, "text").where(n_tokens(F.col("text")) > limit)
    kind = long.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                text = batch.column(1)[n].as_py().encode()
                found = cuts(text, limit, overlap)
                start, end = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array(start), pa.array(end), pa.array(end - start), pa.array([text[a:b].decode() for a, b in found])], names=[key, "piece", "start", "end", "tokens", "text"])

    return long.mapInArrow(split, f"`{key}` {kind}, piece int, start bigint, end bigint, tokens bigint, text string")
