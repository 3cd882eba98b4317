"""Scalar and array expressions of the experiment, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlab.config import OVERLAP, SEQUENCE, SPECIAL


def parse_date(text: Column, two_digit_years: bool = True) -> Column:
    """A date written YYYY-MM-DD, MM/DD/YYYY or MM/DD/YY, blanks around allowed; null if none fits."""
    forms = ["yyyy-MM-dd", "M/d/yyyy"] + (["M/d/yy"] if two_digit_years else [])
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms)).cast("date")


def portable_hash(text: Column) -> Column:
    """A 32-bit number of a string that any engine with md5 can compute."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, unicode_space: bool = True) -> Column:
    """Lower-cased words split at white space (Unicode's, or ASCII's alone)."""
    pattern = r"(?U)\s+" if unicode_space else r"[ \t\n\r\f]+"
    return F.filter(F.split(F.lower(text), pattern), lambda w: w != "")


def shingles(text: Column, n: int = 5, unicode_space: bool = True) -> Column:
    """Distinct runs of ``n`` words; one run of all words if fewer; none of an empty or null text."""
    def runs(ws: Column) -> Column:
        size = F.size(ws)
        every = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(ws, " "))).otherwise(every)

    return F.array_distinct(let(words(F.coalesce(text, F.lit("")), unicode_space), runs))


def shingle_hashes(text: Column, n: int = 5, unicode_space: bool = True) -> Column:
    """64-bit hashes of :func:`shingles`: words are hashed once, runs are hashes of their words' hashes, no run is spelled out."""
    def runs(ws: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, n)))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(every)

    hashed = F.transform(words(F.coalesce(text, F.lit("")), unicode_space), lambda w: F.xxhash64(w))
    return F.array_distinct(let(hashed, runs))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct items; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def expected_level(probabilities: Column) -> Column:
    """Sum of level times probability over a map of level names to probabilities."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda acc, e: acc + e["key"].cast("int") * e["value"])


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its greatest value."""
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, w: s + w), lambda total: F.transform(e, lambda v: v / total))

    return let(let(x, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top)))), shares)


def level_from_logits(x: Column) -> Column:
    """Expected level of an array of logits."""
    p = softmax(x)
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(x) - 1), lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)


def chunk_starts(length: Column, hypothesis: int = 0, size: int = SEQUENCE, special: int = SPECIAL, overlap: int = OVERLAP) -> Column:
    """First token (from 0) of each window over ``length`` tokens; one window for an empty text."""
    room = size - hypothesis - special
    if room <= overlap:
        raise ValueError(f"no room for text: {room} tokens beside the hypothesis, overlap {overlap}")
    more = F.greatest(F.lit(0), F.ceil((length - room) / F.lit(room - overlap))).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: k * (room - overlap))


def chunks(tokens: Column, hypothesis: int = 0, size: int = SEQUENCE, special: int = SPECIAL, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of a token array that leave room for hypothesis and special tokens."""
    room = size - hypothesis - special
    return let(tokens, lambda t: F.transform(chunk_starts(F.size(t), hypothesis, size, special, overlap), lambda s: F.slice(t, s + 1, room)))


def with_special(a: Column, b: Column | None, cls: int, sep: int) -> Column:
    """[CLS] a [SEP] and, if there is a second part, b [SEP]."""
    one = [F.array(F.lit(cls)), a, F.array(F.lit(sep))]
    return F.concat(*one, *([b, F.array(F.lit(sep))] if b is not None else []))


def half_year(date: Column) -> Column:
    """``YYYYH1`` or ``YYYYH2``."""
    return F.concat(F.year(date).cast("string"), F.when(F.month(date) <= 6, F.lit("H1")).otherwise(F.lit("H2")))


def cost_per_10k(mean_tokens: Column, price_per_million) -> Column:
    """Price of 10,000 texts; the price is the caller's, there is no default."""
    return F.lit(10_000.0) * mean_tokens * F.lit(float(price_per_million)) / F.lit(1e6)


def all_finite(vector: Column) -> Column:
    """Whether no element is null, NaN or infinite; false for a null vector."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
