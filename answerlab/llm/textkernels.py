"""Vectorised text kernels shared by the near-duplicate operators.

A *word* is a maximal run of characters other than blank, tab and line break
(``\\n`` or ``\\r``); a *shingle* is a run of ``n`` consecutive lower-cased words, and a text
of fewer than ``n`` words is one shingle.  Everything here works on Arrow batches with numpy:
no per-word Python objects are made, so hashing costs some ten nanoseconds a byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 17
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, _CHUNK + 1024)
            self.up = _powers(int(_BASE), self.size)
            self.down = _powers(pow(int(_BASE), -1, 1 << 64), self.size)


_TABLES = _Tables()


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about a megabyte, so that the temporary arrays stay small."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = "" if t is None else t.replace("\x00", "\x01")
        part.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def word_spans(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, word starts, word ends, first word of each text).

    The last array has ``len(texts) + 1`` entries: text ``i`` has words ``first[i]:first[i + 1]``.
    """
    data = ("\x00".join(texts) + "\x00").lower().encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, dtype=np.uint8)
    gap = (b == 32) | (b == 9) | (b == 10) | (b == 13) | (b == 0)
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.flatnonzero(b == 0)
    first = np.searchsorted(starts, np.concatenate(([0], bounds)), side="left")
    return data, starts, ends, first


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one polynomial prefix sum."""
    b = np.frombuffer(data, dtype=np.uint8)
    _TABLES.upto(len(b) + 1)
    prefix = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _TABLES.up[: len(b)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _TABLES.down[starts]
    return mix64(raw + np.uint64(0x51ED27))


def span_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the word runs ``lo:hi``, as differences of one prefix sum: the same few steps whatever their lengths."""
    _TABLES.upto(len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _TABLES.up[: len(words)], out=prefix[1:])
    return mix64((prefix[hi] - prefix[lo]) * _TABLES.down[lo] + (hi - lo).astype(np.uint64))


def combine(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside each text.

    Returns (hashes, offsets, word index at which each run starts); a text with one to ``n - 1``
    words has one run of all its words, a text without words none.
    """
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(first[:-1] - offsets[:-1], runs) + np.arange(offsets[-1])
    if not len(at):
        return np.empty(0, np.uint64), offsets, at
    return span_hashes(words, at, np.minimum(at + n, np.repeat(first[1:], runs))), offsets, at


def content_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text, equal for equal lower-cased word sequences."""
    return span_hashes(words, first[:-1], first[1:]).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` neighbours from each place on; the last ``width - 1`` places are cut off."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return out if not rest else np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers; a plain sort, which numpy does faster than its ``unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``lo, lo + 1, …`` of each range, one after the other."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def distinct_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of distinct runs of each text."""
    n = np.diff(offsets)
    if not len(hashes):
        return n
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(hashes, kind="stable")  # equal hashes stay in the order of their texts
    again = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return n - np.bincount(doc[order][1:][again], minlength=len(n))


def repeats(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each run stands earlier in its text already."""
    out = np.zeros(len(hashes), bool)
    if len(hashes):
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.argsort(hashes, kind="stable")
        out[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return out


class Shingled:
    """Shingles of one run of texts; see :func:`shingle_texts`."""

    __slots__ = ("start", "data", "starts", "ends", "first", "words", "hashes", "offsets", "at", "size")

    def __init__(self, start: int, texts: list[str], n: int) -> None:
        self.start = start
        self.data, self.starts, self.ends, self.first = word_spans(texts)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.hashes, self.offsets, self.at = combine(self.words, self.first, n)
        self.size = len(texts)


def shingle_texts(texts: Sequence[str | None], n: int = 5) -> Iterator[Shingled]:
    """Shingle all texts, about a megabyte at a time; nulls count as empty texts."""
    for start, part in _chunks(texts):
        yield Shingled(start, part, n)


def minhash(hashes: np.ndarray, offsets: np.ndarray, perms: int, seed: int = 1) -> np.ndarray:
    """(texts, perms) minima of ``perms`` permutations of the 32-bit folded hashes.

    A permutation flips some bits and multiplies by an odd constant modulo 2**32; the hashes
    are well mixed already, so the order of the products is as good as random.

    Texts without shingles get the largest value everywhere.
    """
    n = len(offsets) - 1
    out = np.full((perms, n), 0xFFFFFFFF, dtype=np.uint32)
    live = np.flatnonzero(np.diff(offsets) > 0)
    if not len(live):
        return out.T
    consts = mix64(np.arange(1, 2 * perms + 1, dtype=np.uint64) + np.uint64(seed << 20)) >> np.uint64(32)
    flip, mul = consts[:perms].astype(np.uint32), consts[perms:].astype(np.uint32) | np.uint32(1)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(live), 256):  # blocks that stay in the cache while every permutation passes over them
        part = live[lo : lo + 256]
        begin = offsets[:-1][part]
        piece, cut = x[begin[0] : offsets[part[-1] + 1]], begin - begin[0]
        v = np.empty_like(piece)
        for j in range(perms):
            np.bitwise_xor(piece, flip[j], out=v)
            v *= mul[j]
            out[j, part] = np.minimum.reduceat(v, cut)
    return out.T


#: Bits of a sketch; two texts of similarity s agree in each with chance (1 + s) / 2.
SKETCH_BITS = 96


def bit_sketch(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 32 bits): one bit of each of ``SKETCH_BITS`` MinHash values."""
    odd = np.ascontiguousarray((mix64(signature) & np.uint64(1)).astype(np.uint8))
    packed = np.packbits(odd, axis=1)
    first = np.ascontiguousarray(packed[:, :8]).view("<u8").ravel()
    return first, np.ascontiguousarray(packed[:, 8:]).view("<u4").ravel()


def sketch_limit(threshold: float, deviations: float) -> int:
    """Agreeing bits that a pair at the threshold has, but for a chance of ``deviations`` sigmas."""
    p = (1 + threshold) / 2
    return int(np.floor(SKETCH_BITS * p - deviations * np.sqrt(SKETCH_BITS * p * (1 - p))))


def distinct_sorted(hashes: np.ndarray, offsets: np.ndarray, i: int) -> np.ndarray:
    """The sorted distinct shingle hashes of text ``i``."""
    return distinct(hashes[offsets[i] : offsets[i + 1]])


def jaccard_sorted(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1.0 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
