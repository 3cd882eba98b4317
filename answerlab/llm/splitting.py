"""Splitting oversized texts at natural boundaries, by balanced targets.

The least number of pieces follows from the length, the limit and the overlap; equal-length targets
are placed, and each is snapped to the strongest boundary near it (paragraph before line before
sentence).  While a piece breaks the limit, one more piece is planned, up to as many as it takes if every piece ends at the
last boundary it can reach; that plan meets every limit.  A piece is cut off a boundary only where no boundary
lies within its reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^ \t\n\r]+")
#: Quotes and brackets that may close a sentence after its last sign.
_CLOSING = "\"'”’»)]}"
#: How strong a boundary is.
SENTENCE, LINE, PARAGRAPH = 1, 2, 3
_SCHEMA = (
    "piece int, pieces int, cut string, first_word int, last_word int, n_words int, overlap_words int, "
    "overlap_chars int, ends_at string, piece_text string"
)
_ENDS = {0: "forced", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph"}


def boundaries(text: str) -> tuple[list[int], np.ndarray]:
    """(character offset of each word plus the text's length, strength of the boundary after each word)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    strength = np.zeros(len(spans), np.int8)
    for i, (a, b) in enumerate(spans):
        gap = text[b : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
        breaks = gap.replace("\r\n", "\n").count("\n") + gap.replace("\r\n", "\n").count("\r")
        if breaks:
            strength[i] = PARAGRAPH if breaks > 1 else LINE
        elif text[a:b].rstrip(_CLOSING).endswith((".", "!", "?")):
            strength[i] = SENTENCE
    return [a for a, _ in spans] + [len(text)], strength


def longest_run(strength: np.ndarray) -> int:
    """Most consecutive words without a boundary between them."""
    ends = np.append(np.flatnonzero(strength[:-1]) if len(strength) else [], len(strength) - 1)
    return int(np.max(np.diff(ends, prepend=-1))) if len(strength) else 0


def plan(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends (word counts, exclusive) of the pieces of a text; the last is the text's length."""
    n = len(strength)
    if n <= limit:
        return [n]
    natural = np.flatnonzero(strength) + 1
    least = 1 + -(-(n - limit) // (limit - overlap))
    ends = _balanced(strength, natural, n, limit, overlap, least)
    if ends:
        return ends
    farthest = _farthest(natural, n, limit, overlap)
    for count in range(least + 1, len(farthest) + 1):
        ends = _balanced(strength, natural, n, limit, overlap, count)
        if ends:
            return ends
    return farthest


def _farthest(natural: np.ndarray, n: int, limit: int, overlap: int) -> list[int]:
    """Ends of pieces that each reach for the last boundary within the limit."""
    ends, at = [], 0
    while True:
        reach = at + (limit if not ends else limit - overlap)
        if reach >= n:
            return ends + [n]
        within = int(np.searchsorted(natural, reach, side="right"))
        at = int(natural[within - 1]) if within and natural[within - 1] > at else reach
        ends.append(at)


def _balanced(strength: np.ndarray, natural: np.ndarray, n: int, limit: int, overlap: int, count: int) -> list[int] | None:
    size = (n + overlap * (count - 1)) / count
    near = max(8, int(size / 8))
    ends: list[int] = []
    at = 0
    for k in range(1, count):
        reach = at + (limit if k == 1 else limit - overlap)
        target = min(round(k * (size - overlap) + overlap), reach)
        ahead = natural[(natural > at) & (natural <= reach)]
        if len(ahead):
            close = ahead[np.abs(ahead - target) <= near]
            pool = close if len(close) else ahead
            rank = strength[pool - 1].astype(np.int64) * (n + 1) if len(close) else np.zeros(len(pool), np.int64)
            at = int(pool[np.argmax(rank - np.abs(pool - target))])
        else:
            at = reach
        if at >= n:
            return None
        ends.append(at)
    return ends + [n] if n - at <= limit - overlap else None


def split_text(text: str, limit: int = 512, overlap: int = 64) -> list[tuple]:
    """Pieces of one text as rows of ``_SCHEMA``."""
    at, strength = boundaries(text)
    n = len(strength)
    if not n:
        return []
    cut = "forced" if longest_run(strength) > limit else "natural"
    ends = plan(strength, limit, overlap)
    out, done = [], 0
    for i, end in enumerate(ends):
        first = max(0, done - overlap) if i else 0
        a = at[first] if i else 0
        how = _ENDS[int(strength[end - 1])] if end < n else "end"
        new = at[done] if i else 0
        out.append((i + 1, len(ends), cut, first + 1, end, end - first, done - first, new - a, how, text[a : at[end]]))
        done = end
    return out


def split_oversized(table: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """Numbered pieces of every text of more than ``limit`` words: ``(id, piece, pieces, cut, …)``.

    Each piece has at most ``limit`` words and begins with the last ``overlap`` words of the piece before;
    ``piece_text`` without its first ``overlap_chars`` characters, in order, gives back the whole text.
    ``cut`` is 'forced' if the text has more than ``limit`` consecutive words without a boundary between them.
    Texts within the limit, null and blank texts give no rows; a null id is kept; repeated rows give repeated
    pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    # a text of more than limit words has at least 2 * limit + 1 characters, which the JVM tells without Python
    long = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 2 * limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, at = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    pieces = split_text(text, limit, overlap)
                    if len(pieces) > 1:
                        rows += pieces
                        at += [i] * len(pieces)
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int32()] * 2 + [pa.string()] + [pa.int32()] * 5 + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                        ["id", *(x.split()[0] for x in _SCHEMA.split(", "))],
                    )

    kind = long.schema["id"].dataType.simpleString()
    return long.mapInArrow(run, f"id {kind}, {_SCHEMA}")
