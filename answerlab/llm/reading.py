"""Reading level of each document: regularised ordinal regression on text features.

Features: length of words, sentences and clauses, lexical diversity, rarity of words in this corpus (every word counted), connectives and
a clause-depth proxy (subordinators and commas a sentence).  A partial proportional-odds model with a
ridge penalty is fitted to the graded texts; its thresholds are the calibration to their scale.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm.counting import total_counts
from answerlab.session import materialize

#: Counters of the words of all documents: every word is counted, in an array of fixed size.
COUNTERS = 1 << 19
#: Graded rows the model is fitted on at most, taken by the hash of their id.
LABELLED_ROWS = 20_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STAMP = re.compile(r"^\s*(?:\[\d{1,2}:\d{2}\]\s*\w+:|[-*•]\s|\d+[.)]\s|sec\.\s*\d+\.?)\s*", re.I | re.M)
#: An abbreviation's point (fixed values) ends no sentence.
_STOP = re.compile(
    r"[.!?]+(?=\s|$)(?<!\bcf\.)(?<!\bno\.)(?<!\bpara\.)(?<!\bart\.)(?<!\bseq\.)(?<!\bsched\.)(?<!\bsec\.)|\n\s*\n|\n(?=\s*(?:\[|\d+[.)]|[-*•]\s|sec\.))"
)
_DIGIT = re.compile(r"\d")
_VOWELS = re.compile(r"[aeiouyàâäáéèêëíìîïóòôöúùûü]+")
#: Connectives and subordinators.
_CONNECTIVE = frozenset(
    "although because however therefore whereas unless while though since moreover furthermore nevertheless consequently thus hence "
    "notwithstanding irrespective pending provided accordingly whereby wherein thereof hereby insofar inasmuch otherwise particularly".split()
)
_SUBORDINATOR = frozenset("that which who whom whose where when if whether after before until as by of upon under".split())
_PRONOUN = frozenset("i me my mine we us our you your he him his she her they them their".split())
#: Endings of abstract and learned words.
_ABSTRACT = re.compile(r"(?:tion|sion|ment|ance|ence|ency|ancy|ity|ism|ness|ship|able|ible|ously|ively|ally|ises?|izes?|uates?|ality|ary|ory)s?\Z")
FEATURES = (
    "word_length", "long_words", "syllables", "polysyllables", "sentence_words", "sentence_spread", "clause_words", "commas", "connectives",
    "subordinators", "diversity", "rarity", "rare_words", "log_words", "pronouns", "abstract", "numbers",
)


def sentences_of(text: str) -> list[list[str]]:
    """Lower-cased words of letters of each sentence that has any, without list marks and time stamps."""
    return [w for s in _STOP.split(text.lower()) if (w := _WORD.findall(_STAMP.sub(" ", s)))]


class Vocabulary:
    """What a word adds to the features of its text, kept for every word met: numbers of words, rows of values."""

    _MOST = 1 << 20

    def __init__(self, rarity: np.ndarray) -> None:
        self.rarity = rarity
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.values = np.empty((1024, 9))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new ones are measured first."""
        if len(self.number) > self._MOST:
            self._clear()
        got = [self.number.get(w, -1) for w in words]
        if -1 in got:
            for w in set(words) - self.number.keys():
                n = len(self.number)
                if n == len(self.values):
                    self.values = np.concatenate([self.values, np.empty_like(self.values)])
                self.number[w] = n
                syllables = max(1, len(_VOWELS.findall(w)))
                rare = self.rarity[counter(w)]
                self.values[n] = (
                    len(w), len(w) > 6, syllables, syllables > 3, w in _CONNECTIVE, w in _SUBORDINATOR, rare, w in _PRONOUN,
                    len(w) > 5 and _ABSTRACT.search(w) is not None,
                )
            got = [self.number[w] for w in words]
        return np.array(got, np.int64)


def counter(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (COUNTERS - 1)


def features(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts of three words or more, their features as rows)."""
    at, shape, numbers, rest = [], [], [], []
    for i, text in enumerate(texts):
        per = sentences_of(text) if text is not None else []
        words = [w for s in per for w in s]
        n, s = len(words), len(per)
        if n < 3:
            continue
        mine = vocabulary.numbers(words)
        # diversity by a moving window, so that long texts are comparable to short ones
        window = min(n, 50)
        steps = range(0, n - window + 1, max(1, window // 2))
        diversity = sum(len(set(words[k : k + window])) for k in steps) / (len(steps) * window)
        commas = text.count(",") + text.count(";")
        digits = len(_DIGIT.findall(text))
        at.append(i)
        shape.append(n)
        numbers.append(mine)
        # the sentence a word stands in, on average: long sentences count by their words
        square = sum(len(x) * len(x) for x in per)
        rest.append((math.log(n / s), math.log(square / n), math.log(n / (s + commas)), commas / s, diversity, math.log(n), min(1.0, digits / n)))
    if not at:
        return np.empty(0, np.int64), np.empty((0, len(FEATURES)))
    n = np.array(shape)
    values = vocabulary.values[np.concatenate(numbers)]
    start = np.cumsum(n) - n
    mean = np.add.reduceat(values, start) / n[:, None]
    rare = np.add.reduceat((values[:, 6] > 9).astype(float), start) / n
    r = np.array(rest)
    return np.array(at), np.stack(
        [*mean[:, :4].T, *r[:, :4].T, mean[:, 4], mean[:, 5], r[:, 4], mean[:, 6], rare, r[:, 5], mean[:, 7], mean[:, 8], r[:, 6]], axis=1
    )


def word_rarity(table: DataFrame, text_col: str) -> np.ndarray:
    """Negative log share of each counter's words among all words of all documents."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        words: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            words.update(_WORD.findall(text.lower()))
        if words:
            total += np.bincount([counter(w) for w in words], list(words.values()), COUNTERS).astype(np.int64)

    total = total_counts(table.select(F.col(text_col).alias("text")).where("text is not null"), COUNTERS, count)
    return np.log(max(1, int(total.sum())) / np.maximum(total, 1))


def document_features(table: DataFrame, id_col: str, text_col: str, rarity: np.ndarray) -> DataFrame:
    """``(id, features)``; ``features`` is null for texts of fewer than three words."""
    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = table.sparkSession.sparkContext.broadcast(rarity)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary | None = None
        for batch in batches:
            known = known or Vocabulary(sent.value)
            for lo in range(0, batch.num_rows, 2_048):
                part = batch.slice(lo, 2_048)
                at, x = features(part.column("text").to_pylist(), known)
                size = np.zeros(part.num_rows, np.int64)
                size[at] = len(FEATURES)
                gone = size == 0
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32(), mask=np.append(gone, False))
                out = pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), out], ["id", "features"])

    return rows.mapInArrow(run, f"id {kind}, features array<double>")


class OrdinalModel:
    """Partial proportional odds: P(level > k) = sigmoid((w + d_k)·x - b_k).

    ``w`` is shared by all thresholds; the departures ``d_k`` are shrunk to nothing unless the graded texts call for
    them, as the step to specialist prose differs in kind from the steps below it.
    """

    def __init__(self, levels: list[int], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.levels, self.mean, self.scale, self.weights, self.cuts = levels, mean, scale, weights, cuts

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(texts, thresholds): log-odds of lying above each threshold."""
        return _expand((x - self.mean) / self.scale) @ self.weights - self.cuts[None, :]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The expected level."""
        above = 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))
        return self.levels[0] + above @ np.diff(self.levels)

    def level(self, x: np.ndarray) -> np.ndarray:
        """The median level: as many steps up as are taken with a chance of one half or more."""
        return np.array(self.levels)[(self.margins(x) >= 0).sum(1)]


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -4, 4)
    return np.hstack([z, z * np.abs(z) / 4])


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = 3e-3) -> OrdinalModel:
    """Fit by Newton steps on the mean log-likelihood of all thresholds; see :class:`OrdinalModel`."""
    levels = sorted(set(y.tolist()))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expand((x - mean) / scale)
    k = len(levels) - 1
    if k < 1:
        return OrdinalModel(levels, mean, scale, np.zeros((z.shape[1], 0)), np.zeros(0))
    above = np.array([[v > cut for cut in levels[:-1]] for v in y.tolist()], float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    theta = np.concatenate([np.zeros(z.shape[1]), np.log((1 - share) / share)])

    def gradient(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z @ t[:-k][:, None] - t[-k:][None, :], -30, 30)))
        err = (p - above) / len(z)
        weight = p * (1 - p) / len(z)
        grad = np.concatenate([z.T @ err.sum(1) + ridge * t[:-k], -err.sum(0)])
        top = (z * weight.sum(1)[:, None]).T @ z + ridge * np.eye(z.shape[1])
        cross = -(z.T @ weight)
        hess = np.block([[top, cross], [cross.T, np.diag(weight.sum(0)) + 1e-6 * np.eye(k)]])
        return grad, hess

    for _ in range(60):
        grad, hess = gradient(theta)
        step = np.linalg.solve(hess + 1e-6 * np.eye(len(theta)), grad)
        theta -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    shared, cuts = theta[:-k], np.sort(theta[-k:])
    each = [_depart(z, above[:, j], shared, cuts[j], ridge) for j in range(k)]
    return OrdinalModel(levels, mean, scale, np.stack([shared + d for d, _ in each], axis=1), np.array([c for _, c in each]))


def _depart(z: np.ndarray, above: np.ndarray, shared: np.ndarray, cut: float, ridge: float) -> tuple[np.ndarray, float]:
    """(departure from the shared weights, cut) of one threshold, ridge-penalised, by Newton steps."""
    base, t = z @ shared, np.concatenate([np.zeros(z.shape[1]), [cut]])
    x = np.hstack([z, -np.ones((len(z), 1))])
    keep = np.concatenate([np.full(z.shape[1], ridge), [1e-6]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(base + x @ t, -30, 30)))
        grad = x.T @ (p - above) / len(z) + np.concatenate([ridge * t[:-1], [0.0]])
        hess = (x * (p * (1 - p) / len(z))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        t -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return t[:-1], float(t[-1])


def graded(labels: DataFrame, id_col: str, level_col: str, most: int = LABELLED_ROWS) -> DataFrame:
    """``(id, level)``: the median of a document's distinct grades; null grades never count."""
    one = labels.where(F.col(level_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(level_col).alias("v"), "rater")
    per = one.distinct().groupBy("id").agg(F.expr("percentile_approx(v, 0.5)").alias("level"))
    return per.orderBy(F.xxhash64("id")).limit(most)


def reading_levels(documents: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, level_col: str) -> DataFrame:
    """``(id, level, score)`` per document row; both null for texts of fewer than three words.

    ``labels`` has the columns ``label_id``, ``level_col`` and ``rater``.  Equal texts get equal
    levels; repeated rows stay repeated; without any graded text every level is null.  Other columns are ignored.
    """
    rarity = word_rarity(documents, text_col)
    feats = materialize(document_features(documents, id_col, text_col, rarity))
    grades = graded(labels, label_id, level_col)
    train = feats.where("features is not null").join(F.broadcast(grades), "id").dropDuplicates(["id"]).select("features", "level").toPandas()
    if train.empty:
        return feats.select("id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("score"))
    model = fit_ordinal(np.array(train["features"].tolist()), train["level"].to_numpy())
    kind = feats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("features")
            live = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            x = col.drop_null().flatten().to_numpy().reshape(-1, len(FEATURES))
            level, score = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            level[live], score[live] = (model.level(x), model.score(x)) if len(live) else (0, 0.0)
            gone = np.ones(batch.num_rows, bool)
            gone[live] = False
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(level, mask=gone), pa.array(score, mask=gone)], ["id", "level", "score"])

    return feats.mapInArrow(run, f"id {kind}, level int, score double")


def level_profile(levels: DataFrame, documents: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Documents per source (trimmed, lower-cased, hyphens as underscores) and level."""
    source = F.translate(F.lower(F.trim(F.col(source_col))), "-", "_").alias("source")
    once = documents.select(F.col(id_col).alias("id"), source).dropDuplicates(["id"])
    return levels.dropDuplicates(["id"]).join(once, "id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("documents"))
