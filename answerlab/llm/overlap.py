"""Same or near-same records across splits: Aho-Corasick automata over sharded evaluation passages scan whole training texts.

Passages.  An evaluation text of ``n`` runs of five words is tiled by passages of 16 and more words, some words
off its ends.  Two texts of similarity ``s`` differ in at most ``(1 - s) n`` runs, and each place where
they differ (insertion, deletion, replacement, moved block) costs ``4 (1 + s)`` of them, a loss at an end more than
that before it reaches a passage.  So at most ``kill = (1 - s) n / (4 (1 + s))`` passages are broken, fewer than there are:
every partner holds at least ``m - kill`` of the ``m`` passages word for word.  A text too short to lose a passage
has its middle as the only one.  In a text that repeats runs of its own the bound holds for the passages of first occurrences; where these are
too few, all its passages count.

Choice.  So of any ``kill + 1 + spare`` firm passages of a record a partner holds ``1 + spare``, whichever they are.  Each record takes
those whose anchors the fewest chunks hold; where more than ``kill`` have an anchor that no chunk holds, the record has no partner
and leaves.  Only the passages taken are sent to chunks, so popular ones are not sent to every chunk there is.

Sharding.  Training texts are kept whole, in chunks of bounded size.  A passage taken goes, once, to the chunks that hold its anchor, the
rarest twelve words of its first sixteen (by a sketch of fixed size that counts the twelve-word runs of all training texts),
which any text that holds the passage emits too.  Each chunk builds one automaton over the passages it was sent and streams all its
texts through it.  A chunk's anchors are distinct, and so are passages, so neither boilerplate nor copies multiply what is sent.

Candidates.  A text that holds one of the passages a record takes is a candidate.  Where one of these is popular,
because boilerplate makes up much of the text, their matches are not joined with
their owners: both sides' texts emit their rarest five-word runs instead, as many as a partner may lack and one more, and only texts
that share one of these are candidates.  Candidates are filtered by size, which is exact, and verified exactly.

Coverage, where asked for.  A passage's interval of the evaluation text counts where any training text holds it; merged intervals are the coverage
of the record.  One match is enough, so every passage goes to one chunk that holds its anchor first, and only what is not found there to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import textkernels as K
from answerlab.llm.counting import total_counts
from answerlab.llm.similarity import rows_of, sets_for, verify_pairs
from answerlab.session import materialize, release, semi_join_checked, small_enough, spread, sweep

_SHINGLE = 5
#: Words of a tiled passage at least, and of its anchor; five-word runs that it has.
_WIDTH, _ANCHOR = 16, 12
_WINDOW = _WIDTH - _SHINGLE + 1
_MARGIN = 8
#: Counters of the sketch that tells common runs of words from rare ones.
_COUNTERS = 1 << 18
#: Between two texts of a chunk; no word has this code.
_GAP = 1
#: A chunk is closed at this many texts or words: what one task holds at once.
CHUNK_TEXTS, CHUNK_WORDS = 8_192, 4_000_000
#: Passages of a record that are looked for besides those of which a partner must hold one.
_SPARE = 2


class Tiling:
    """The passages of evaluation texts for one threshold."""

    def __init__(self, threshold: float) -> None:
        per_break = (_SHINGLE - 1) * (1 + threshold)
        if (1 - threshold) * 2.25 * _WIDTH > per_break + 1e-9:
            least = (2.25 * _WIDTH - _SHINGLE + 1) / (2.25 * _WIDTH + _SHINGLE - 1)
            raise ValueError(f"passages of {_WIDTH} words lose no partner only from a similarity of {least:.2f} on")
        self.threshold, self.per_break = threshold, per_break
        #: Distinct runs up to which a text is short, and those of its longest partner.
        self.short = _WINDOW + 5
        self.short_partner = int(self.short / threshold + 1e-9)

    def passages(self, s: K.Shingled, words_: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first word, end word, anchor, breakable passages of the text, firm) of every passage of some texts.

        ``words_`` are the words' codes, ``weights`` rank the runs an anchor may be.  Of the firm passages of a text no more than the breakable ones can be broken.
        """
        words = np.diff(s.first)
        runs = np.diff(s.offsets)
        later = K.repeats(s.hashes, s.offsets)
        distinct = runs - np.add.reduceat(np.append(later, False), s.offsets[:-1])[: len(runs)] * (runs > 0)
        lost = (1 - self.threshold) * distinct
        kill = np.floor(lost / self.per_break + 1e-9).astype(np.int64)
        again = distinct < runs
        # short texts that repeat themselves: distinct runs, one more than a partner may lack
        odd = again & (distinct <= self.short)
        text, lo, hi, can = [], [], [], []
        for i in np.flatnonzero(odd).tolist():
            at = np.flatnonzero(~later[s.offsets[i] : s.offsets[i + 1]])[: int(lost[i] + 1e-9) + 1]
            text += [i] * len(at)
            lo += (s.first[i] + at).tolist()
            hi += (s.first[i] + at + _SHINGLE).tolist()
            can += [len(at)] * len(at)
        one = np.flatnonzero((words > 0) & (kill == 0) & ~again)
        trim = np.floor(lost[one] + 1e-9).astype(np.int64)
        many = np.flatnonzero(((kill > 0) | again) & ~odd)
        margin = np.clip((words[many] - _WIDTH * (kill[many] + 1)) // 2, 0, _MARGIN)
        inner = words[many] - 2 * margin
        count = np.maximum(1, inner // _WIDTH)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin, inner_, count_ = (np.repeat(x, count) for x in (s.first[many] + margin, inner, count))
        text = np.concatenate([np.array(text, np.int64), one, np.repeat(many, count)])
        lo = np.concatenate([np.array(lo, np.int64), s.first[one] + trim, begin + k * inner_ // count_])
        hi = np.concatenate([np.array(hi, np.int64), s.first[one + 1] - trim, begin + (k + 1) * inner_ // count_])
        can = np.concatenate([np.array(can, np.int64), np.zeros(len(one), np.int64), np.repeat(kill[many], count)])
        # run ``i`` of a text starts at its word ``i``
        run = lo - s.first[text] + s.offsets[text]
        size = np.maximum(hi - lo - _SHINGLE + 1, 1)
        # a lost run breaks one of the passages that hold only first occurrences, so those are firm
        seen = np.concatenate(([0], np.cumsum(later)))
        firm = (seen[np.minimum(run + size, len(later))] == seen[run]) | odd[text]
        enough = np.bincount(text, firm, len(words)) > np.bincount(text, can / np.maximum(np.bincount(text, minlength=len(words))[text], 1), len(words))
        weak = ~enough[text] & ~odd[text]
        firm, can = firm | weak, np.where(weak, words[text], can)
        # the anchor: any run of a short passage, the rarest twelve words of the first sixteen of others
        anchor = np.empty(len(text), np.uint64)
        for short, width in ((True, _SHINGLE), (False, _ANCHOR)):
            part = np.flatnonzero((hi - lo < _WIDTH) == short)
            if len(part):
                grams, offsets = K.combine(words_.astype(np.uint64), s.first, width)[:2]
                order = _ranked(grams, weights, short)
                size = np.maximum(np.minimum(hi[part] - lo[part], _WIDTH) - width + 1, 1)
                begin = lo[part] - s.first[text[part]] + offsets[text[part]]
                anchor[part] = np.minimum.reduceat(order[K.ranges(begin, size)], np.cumsum(size) - size)
        return text, lo, hi, anchor, can, firm

    def anchors(self, codes: np.ndarray, first: np.ndarray, distinct: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Distinct anchors of all passages that some training texts may hold of a partner."""
        grams, offsets, _ = K.combine(codes.astype(np.uint64), first, _ANCHOR)
        runs, span = np.diff(offsets), _WIDTH - _ANCHOR + 1
        least = K.sliding_min(_ranked(grams, weights, False), span)
        inside = np.arange(len(least)) + span <= np.repeat(offsets[1:], runs)[: len(least)]
        # a shorter passage is a short text's: its partners are short too and emit every run
        few = np.flatnonzero(distinct <= self.short_partner)
        size = np.diff(first)[few]
        grams, _, _ = K.combine(codes[K.ranges(first[few], size)].astype(np.uint64), np.concatenate(([0], np.cumsum(size))), _SHINGLE)
        return K.distinct(np.concatenate([least[inside], _ranked(grams, weights, True)]))


def _ranked(grams: np.ndarray, weights: np.ndarray, short: bool) -> np.ndarray:
    """The runs' ranks: the logarithm of their count before their hash; short texts' runs rank by hash, apart from the others."""
    weight = np.uint64(63) if short else weights[(grams & np.uint64(_COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    return (weight << np.uint64(58)) | (grams >> np.uint64(6))


def run_weights(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the counts of all runs of twelve and of five words of the chunks, by counter; what reaches the driver has a fixed size."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for lengths, codes in zip(batch.column("lengths"), batch.column("codes")):
            first = np.concatenate(([0], np.cumsum(lengths.values.to_numpy())))
            words = np.frombuffer(codes.as_py(), np.uint16).astype(np.uint64)
            for part, width in ((total[:_COUNTERS], _ANCHOR), (total[_COUNTERS:], _SHINGLE)):
                grams = K.combine(words, first, width)[0]
                part += np.bincount((grams & np.uint64(_COUNTERS - 1)).astype(np.int64), minlength=_COUNTERS)

    total = np.ceil(np.log2(total_counts(chunks.select("lengths", "codes"), 2 * _COUNTERS, count) + 1)).astype(np.uint8)
    return total[:_COUNTERS], total[_COUNTERS:]


def _rare_runs(rows: DataFrame, owners: DataFrame, keys: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """``(key, size, run)``: of each text the rarest distinct runs of five words, one more than a partner may lack, in one order for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.shingle_texts(batch.column("text").to_pylist(), _SHINGLE):
                grams = K.combine(_codes(s.words).astype(np.uint64), s.first, _SHINGLE)[0]
                rank = weights[(grams & np.uint64(_COUNTERS - 1)).astype(np.int64)]
                keys_, out = K.content_keys(s.words, s.first), []
                for i in np.flatnonzero(np.diff(s.first) > 0).tolist():
                    mine = slice(s.offsets[i], s.offsets[i + 1])
                    hashes, at = np.unique(s.hashes[mine], return_index=True)
                    taken = np.lexsort((hashes, rank[mine][at]))[: int((1 - threshold) * len(hashes) + 1e-9) + 1]
                    out.append((np.full(len(taken), keys_[i]), np.full(len(taken), len(hashes)), hashes[taken].view(np.int64)))
                if out:
                    key, size, runs = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(size, pa.int32()), pa.array(runs)], ["key", "size", "run"])

    # another text of one of the ids can only add a candidate
    return rows_of(rows, owners, keys).select("text").mapInArrow(run, "key long, size int, run long").distinct()


def _anchors(chunks: DataFrame, tiling: Tiling, weights: np.ndarray) -> DataFrame:
    """``(for_chunk, anchor)``: the distinct anchors of each chunk; with what :func:`_evaluation` returns all that decides where a passage goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, lengths, codes in zip(*(batch.column(c) for c in ("chunk", "sizes", "lengths", "codes"))):
                first = np.concatenate(([0], np.cumsum(lengths.values.to_numpy())))
                got = tiling.anchors(np.frombuffer(codes.as_py(), np.uint16), first, sizes.values.to_numpy(), weights).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), chunk.as_py())), pa.array(got)], ["for_chunk", "anchor"])

    return chunks.select("chunk", "sizes", "lengths", "codes").mapInArrow(run, "for_chunk long, anchor long")


def _codes(words: np.ndarray) -> np.ndarray:
    """A 16-bit code of each word, from its hash; a clash can only add a candidate."""
    return ((words >> np.uint64(13)) % np.uint64(0xD7F0) + np.uint64(_GAP + 1)).astype(np.uint16)


def _binary(codes: np.ndarray, size: np.ndarray) -> pa.Array:
    """One binary value a passage of ``size`` codes."""
    offsets = np.concatenate(([0], np.cumsum(size * 2))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])


_EVAL = "key long, size int, total int, kill int, firm boolean, passage long, anchor long, codes binary, lo int, hi int"


def _evaluation(rows: DataFrame, tiling: Tiling, weights: np.ndarray) -> DataFrame:
    """``(id, text, split)`` to membership rows ``(id, split, key)`` and passage rows.

    In a task a text's passages come once, and a passage's words once.
    """
    kind = rows.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in _EVAL.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known: set[int] = set()
        for batch in batches:
            for s in K.shingle_texts(batch.column("text").to_pylist(), _SHINGLE):
                live = np.flatnonzero(np.diff(s.first) > 0)
                keys = K.content_keys(s.words, s.first)
                fresh = np.array([bool(k not in seen and not seen.add(k)) for k in keys.tolist()])
                words = _codes(s.words)
                found = tiling.passages(s, words, weights)
                text, lo, hi, anchor, kill, firm = (x[fresh[found[0]]] for x in found)
                passage = K.span_hashes(s.words, lo, hi).view(np.int64)
                first = np.array([i for i, p in enumerate(passage.tolist()) if p not in known and not known.add(p)], np.int64)
                codes = _binary(words[K.ranges(lo[first], (hi - lo)[first])], (hi - lo)[first])
                where = np.full(len(passage), -1)
                where[first] = np.arange(len(first))
                codes = codes.take(pa.array(where, pa.int64(), mask=where < 0))
                total = np.bincount(text, hi - lo, minlength=s.size).astype(np.int64)
                size = K.distinct_counts(s.hashes, s.offsets)
                per = [keys[text], size[text], total[text], kill, firm, passage, anchor.view(np.int64), codes, lo - s.first[text], hi - s.first[text]]
                part = [batch.column(c).take(pa.array(live + s.start)) for c in ("id", "split")]
                cols = [pa.concat_arrays([p, pa.nulls(len(text), p.type)]) for p in part]
                for name, col, spec in zip(names, per, _EVAL.split(", ")):
                    t = types[spec.split()[1]]
                    head = pa.array(keys[live], t) if name == "key" else pa.nulls(len(live), t)
                    cols.append(pa.concat_arrays([head, col if name == "codes" else pa.array(col, t)]))
                yield pa.RecordBatch.from_arrays(cols, ["id", "split", *names])

    return rows.select("id", "split", "text").mapInArrow(run, f"id {kind}, split string, {_EVAL}")


def _training(rows: DataFrame) -> DataFrame:
    """``(id, text)`` to chunks of whole texts: their keys, sizes and words as codes, and the ids of the rows."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        id_keys: list[np.ndarray] = []
        parts: list[tuple] = []
        seen: set[int] = set()
        texts = words = 0

        def chunk() -> pa.RecordBatch:
            one = lambda x, t: pa.array([x], pa.list_(t))
            keys, size, length, codes = (np.concatenate(x) for x in zip(*parts))
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), one(keys, pa.int64()), one(size, pa.int32()), one(length, pa.int32()),
                    pa.array([codes.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), one(np.concatenate(id_keys), pa.int64()),
                ],
                ["chunk", "keys", "sizes", "lengths", "codes", "ids", "id_keys"],
            )

        for batch in batches:
            for s in K.shingle_texts(batch.column("text").to_pylist(), _SHINGLE):
                keys, count = K.content_keys(s.words, s.first), np.diff(s.first)
                live = np.flatnonzero(count > 0)
                ids.append(batch.column("id").take(pa.array(live + s.start)))
                id_keys.append(keys[live])
                fresh = np.array([i for i in live.tolist() if keys[i] not in seen and not seen.add(keys[i])], np.int64)
                codes = _codes(s.words)[K.ranges(s.first[fresh], count[fresh])]
                parts.append((keys[fresh], K.distinct_counts(s.hashes, s.offsets)[fresh], count[fresh], codes))
                texts, words = texts + len(live), words + len(codes)
                if texts >= CHUNK_TEXTS or words >= CHUNK_WORDS:
                    yield chunk()
                    number, texts, words = number + 1, 0, 0
                    ids, id_keys, parts, seen = [], [], [], set()
        if parts:
            yield chunk()

    schema = f"chunk long, keys array<long>, sizes array<int>, lengths array<int>, codes binary, ids array<{kind}>, id_keys array<long>"
    return rows.select("id", "text").mapInArrow(run, schema)


def _possible(passages: pa.Array, grams: np.ndarray) -> np.ndarray:
    """The passages whose first, middle and last twelve words are among the chunk's runs (shorter passages are let through).

    A filter before the automaton is built: it spares nodes, the automaton alone decides.
    """
    ends = np.frombuffer(passages.buffers()[1], np.int32)[passages.offset : passages.offset + len(passages) + 1]
    size, codes = np.diff(ends) // 2, np.frombuffer(passages.buffers()[2], np.uint16)[ends[0] // 2 : ends[-1] // 2]
    mine, offsets, _ = K.combine(codes.astype(np.uint64), np.concatenate(([0], np.cumsum(size))), _ANCHOR)
    known = np.sort(grams)
    out = np.ones(len(size), bool)
    for at in (offsets[:-1], (offsets[:-1] + offsets[1:] - 1) // 2, offsets[1:] - 1):
        spot = np.minimum(np.searchsorted(known, mine[at]), len(known) - 1)
        out &= (known[spot] == mine[at]) | (size < _ANCHOR)
    return np.flatnonzero(out)


_HITS = pa.schema([("passage", pa.int64()), ("t", pa.int64()), ("t_size", pa.int32()), ("chunk", pa.int64())])


def _scan(chunks: pa.Table, passages: pa.Table) -> pa.Table:
    """Build one chunk's automaton and stream its texts through it: ``(passage, t, t_size, chunk)`` of every match."""
    if not chunks.num_rows or not passages.num_rows:
        return _HITS.empty_table()
    row = {c: chunks.column(c)[0] for c in ("chunk", "keys", "sizes", "lengths", "codes")}
    keys, sizes, lengths = (row[c].values.to_numpy() for c in ("keys", "sizes", "lengths"))
    codes = np.frombuffer(row["codes"].as_py(), np.uint16)
    ends = np.cumsum(lengths)
    ids, first = np.unique(passages.column("passage").to_numpy(), return_index=True)
    words = passages.column("codes").take(pa.array(first)).combine_chunks()
    live = _possible(words, K.combine(codes.astype(np.uint64), np.concatenate(([0], ends)), _ANCHOR)[0])
    ids, words = ids[live], words.take(pa.array(live))
    if not len(ids):
        return _HITS.empty_table()
    automaton = ahocorasick.Automaton()
    # passages whose words have the same codes are one word of the automaton
    known: dict[bytes, int] = {}
    alike = np.array([known.setdefault(passage, len(known)) for passage in words.to_pylist()])
    for passage, i in known.items():
        automaton.add_word(passage.decode("utf-16-le"), i)
    automaton.make_automaton()
    order, many = np.argsort(alike, kind="stable"), np.bincount(alike)
    stream = np.insert(codes, ends[:-1], _GAP)
    ends = ends + np.arange(len(ends))
    found = np.fromiter((x for pair in automaton.iter(stream.tobytes().decode("utf-16-le")) for x in pair), np.int64).reshape(-1, 2)
    text = np.searchsorted(ends, found[:, 0], side="right")
    both = K.distinct(found[:, 1] * len(keys) + text)
    word, text = both // len(keys), both % len(keys)
    passage, text = order[K.ranges((np.cumsum(many) - many)[word], many[word])], np.repeat(text, many[word])
    cols = [pa.array(ids[passage]), pa.array(keys[text]), pa.array(sizes[text], pa.int32()), pa.array(np.full(len(text), row["chunk"].as_py()))]
    return pa.Table.from_arrays(cols, schema=_HITS)


def _covered(marks):
    """Words of the merged intervals of matched passages."""
    hit = F.array_sort(F.filter(marks, lambda p: p["hit"]))
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    grow = lambda a, p: F.struct((a["words"] + F.greatest(p["hi"] - F.greatest(p["lo"], a["end"]), F.lit(0))).alias("words"), F.greatest(a["end"], p["hi"]).alias("end"))
    return F.aggregate(hit, zero, grow)["words"]


#: Training texts that hold a passage from which on its matches are not joined.
_HOT = 256


class Overlaps:
    """The scan of training texts for evaluation records, and its results.

    ``links``: ``(e, t, similarity)`` between distinct texts.  ``evaluation``: ``(split, id, key)``; ``training``: ``(id, key)``; both hold every
    row that counts.  ``records``, with ``coverage`` alone: ``(key, coverage)``, one row per distinct evaluation text.
    """

    def __init__(
        self, training: DataFrame, evaluations: dict[str, DataFrame], id_col: str, text_col: str, threshold: float = 0.8, coverage: bool = True
    ) -> None:
        tiling = Tiling(threshold)

        def rows(df: DataFrame, split: str | None) -> DataFrame:
            out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(split).cast("string").alias("split"))
            return out.where("id is not null and text is not null")

        parts = [rows(df, name) for name, df in evaluations.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        train = rows(training, None)
        self._shards = spread(train, least=48)
        self._chunks = materialize(_training(train))
        weights, run_weights_ = run_weights(self._chunks)
        left = materialize(_evaluation(every, tiling, weights))
        self.evaluation = materialize(left.where("id is not null").select("split", "id", "key").distinct())
        pair = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("id_keys").alias("key"))).alias("x")
        self.training = materialize(self._chunks.select(pair).select("x.id", "x.key").distinct())
        anchors = materialize(_anchors(self._chunks, tiling, weights))
        words = left.where("codes is not null").select("passage", "codes")
        taken = self._taken(left, anchors)
        sweep(train.sparkSession)
        hits = self._hits(taken, words, anchors)
        if coverage:
            self.records = self._coverage(left, words, anchors)
        release(self._chunks, left, anchors)
        pairs = self._candidates(taken, hits, every, train, threshold, run_weights_)
        release(taken, hits)
        self.links = materialize(self._links(pairs, every, train, threshold))

    @staticmethod
    def _taken(left: DataFrame, anchors: DataFrame) -> DataFrame:
        """``(e, size, need, passage, anchor)``: the passages to look for of the records that may have a partner; one shared is enough, the spare ones make up for texts beyond the bound."""
        held = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("chunks"))
        firm = left.where("firm").select("key", "size", "kill", "passage", "anchor").join(held, "anchor", "left")
        # fewest chunks first, then the anchor's rank
        order = F.struct(F.coalesce("chunks", F.lit(0)).cast("int").alias("chunks"), F.shiftrightunsigned("anchor", 58).cast("int").alias("rank"), "passage", "anchor")
        of = firm.groupBy("key").agg(F.max("size").alias("size"), F.max("kill").alias("kill"), F.collect_set(order).alias("all"))
        of = of.select(F.col("key").alias("e"), "size", "kill", F.slice(F.array_sort("all"), 1, F.col("kill") + 1 + _SPARE).alias("all"))
        of = of.where(F.size(F.filter("all", lambda p: p["chunks"] == 0)) <= F.col("kill"))
        some = of.select("e", "size", F.explode(F.filter("all", lambda p: p["chunks"] > 0)).alias("p"))
        return materialize(some.select("e", "size", F.lit(1).alias("need"), "p.passage", "p.anchor"))

    def _scanned(self, sent: DataFrame) -> DataFrame:
        """The matches of the passages ``(for_chunk, passage, codes)`` in their chunks, ``(passage, t, t_size)``."""
        whole = self._chunks.select("chunk", "keys", "sizes", "lengths", "codes").repartition(self._shards, "chunk").groupBy("chunk")
        both = whole.cogroup(sent.repartition(self._shards, "for_chunk").groupBy("for_chunk"))
        return both.applyInArrow(_scan, "passage long, t long, t_size int, chunk long").select("passage", "t", "t_size")

    def _hits(self, taken: DataFrame, words: DataFrame, anchors: DataFrame) -> DataFrame:
        """``(passage, t, t_size)``: every training text that holds a passage taken, once."""
        wanted = materialize(taken.select("passage", "anchor").distinct())
        # tasks each have a passage's words once; it is sent once
        known = semi_join_checked(words, wanted, "passage").dropDuplicates(["passage"]).join(wanted, "passage")
        sent = materialize(known.join(semi_join_checked(anchors, materialize(wanted.select("anchor").distinct()), "anchor"), "anchor").select("for_chunk", "passage", "codes"))
        hits = materialize(self._scanned(sent).distinct())
        release(wanted, sent)
        return hits

    def _coverage(self, left: DataFrame, words: DataFrame, anchors: DataFrame) -> DataFrame:
        """``(key, coverage)`` of every evaluation text."""
        # a chunk for each anchor, spread by hash
        held = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.struct(F.xxhash64("anchor", "for_chunk").alias("h"), "for_chunk")).alias("one"))
        there = left.where("passage is not null").select("passage", "anchor").distinct().join(held, "anchor")
        there = materialize(there.join(words.dropDuplicates(["passage"]), "passage").select("passage", "anchor", "codes", "chunks", F.col("one.for_chunk").alias("one")))
        first = materialize(self._scanned(there.select(F.col("one").alias("for_chunk"), "passage", "codes")).select("passage").distinct())
        rest = there.where("chunks > 1").join(first, "passage", "left_anti").join(anchors, "anchor").where("for_chunk != one")
        rest = materialize(self._scanned(rest.select("for_chunk", "passage", "codes")).select("passage").distinct())
        found = first.union(rest).withColumn("hit", F.lit(True))
        owners = left.where("passage is not null").select("key", "total", "passage", "lo", "hi").join(found, "passage", "left")
        marks = owners.groupBy("key").agg(F.max("total").alias("total"), F.collect_set(F.struct("lo", "hi", F.coalesce("hit", F.lit(False)).alias("hit"))).alias("marks"))
        out = materialize(marks.select("key", (_covered(F.col("marks")) / F.col("total")).alias("coverage")))
        release(there, first, rest)
        return out

    def _candidates(self, taken: DataFrame, hits: DataFrame, every: DataFrame, train: DataFrame, threshold: float, weights: np.ndarray) -> DataFrame:
        """``(e, t)``, once: pairs that may be similar, and all that are."""
        counts = materialize(hits.groupBy("passage").agg(F.count(F.lit(1)).alias("hits")))
        side = F.broadcast(counts) if small_enough(counts) else counts
        report = materialize(taken.join(side, "passage").select("e", "size", "need", "passage", (F.col("hits") > _HOT).alias("hot")))
        near = (F.col("size") >= F.col("t_size") * threshold - 1e-6) & (F.col("t_size") >= F.col("size") * threshold - 1e-6)
        # the popular ones of which a partner may hold all
        hot = materialize(report.where("hot").groupBy("e").agg(F.count(F.lit(1)).alias("popular")))
        side = F.broadcast(hot) if small_enough(hot) else hot
        cold = report.where("not hot").join(side, "e", "left")
        cold = cold.join(hits, "passage").where(near).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("need") - F.coalesce("popular", F.lit(0))).alias("need"))
        pairs = cold.where("n >= need").select("e", "t")
        open_ = materialize(report.where("hot").join(side, "e").where("popular >= need").select("e", "passage"))
        if not open_.isEmpty():
            mine = materialize(open_.select(F.col("e").alias("key")).distinct())
            theirs = materialize(semi_join_checked(hits, materialize(open_.select("passage").distinct()), "passage").select(F.col("t").alias("key")).distinct())
            left = _rare_runs(every, self.evaluation, mine, weights, threshold).withColumnRenamed("key", "e")
            right = _rare_runs(train, self.training, theirs, weights, threshold).select(F.col("key").alias("t"), F.col("size").alias("t_size"), "run")
            pairs = pairs.union(left.join(right, "run").where(near).select("e", "t"))
        return materialize(pairs.distinct())

    def _links(self, pairs: DataFrame, every: DataFrame, train: DataFrame, threshold: float) -> DataFrame:
        same = pairs.where("e = t").select("e", "t", F.lit(1.0).alias("similarity"))
        different = pairs.where("e != t").select(F.col("e").alias("a"), F.col("t").alias("b"))
        keys = materialize(different.select(F.col("a").alias("key")).union(different.select("b")).distinct())
        texts = every.select("id", "text").union(train.select("id", "text"))
        sets = sets_for(texts, self.evaluation.select("id", "key").union(self.training), keys)
        found = verify_pairs(different, sets, threshold)
        return same.unionByName(found.select(F.col("a").alias("e"), F.col("b").alias("t"), "similarity"))

    def _expanded(self) -> DataFrame:
        """``(split, train_id, eval_id, similarity, again)`` of every link and its members' ids; a pair of ids comes twice, either way round, only where ``again``.

        That takes an id that stands on both sides or with several texts, so the others need no shuffle to be told apart.
        """
        left_keys, right_keys = (materialize(self.links.select(F.col(c).alias("key")).distinct()) for c in "et")
        left = semi_join_checked(self.evaluation, left_keys, "key").select("split", F.col("id").alias("eval_id"), F.col("key").alias("e"))
        right = semi_join_checked(self.training, right_keys, "key").select(F.col("id").alias("train_id"), F.col("key").alias("t"))
        every = left.select(F.col("eval_id").alias("id"), F.col("e").alias("key"), "split").union(right.select("train_id", "t", F.lit(None).cast("string")))
        odd = every.groupBy("id", "split").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(
            F.max("n").alias("n"), F.max(F.col("split").isNull()).alias("train"), F.max(F.col("split").isNotNull()).alias("eval")
        )
        odd = materialize(odd.where("n > 1 or train and eval").select("id"))
        side = F.broadcast(odd) if small_enough(odd) else odd
        left, right = (
            df.join(side.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_odd")), c, "left") for df, c in ((left, "eval_id"), (right, "train_id"))
        )
        again = F.coalesce("eval_id_odd", F.lit(False)) | F.coalesce("train_id_odd", F.lit(False))
        return self.links.join(left, "e").join(right, "t").select("split", "train_id", "eval_id", "similarity", again.alias("again"))

    def pairs(self) -> DataFrame:
        """``(split, train_id, eval_id, similarity)``, one row per pair of ids and split."""
        both = self._expanded()
        once = both.where("not again").select("split", "train_id", "eval_id", "similarity")
        return once.union(both.where("again").groupBy("split", "train_id", "eval_id").agg(F.max("similarity").alias("similarity")))

    def id_pairs(self) -> DataFrame:
        """``(split, train_id, eval_id)``, one row per unordered pair of ids and split; ``train_id`` is the smaller."""
        both = self._expanded().select("split", F.least("train_id", "eval_id").alias("train_id"), F.greatest("train_id", "eval_id").alias("eval_id"), "again")
        return both.where("not again").drop("again").union(both.where("again").drop("again").distinct())

    def per_text(self) -> DataFrame:
        """``(key, coverage, texts, records)`` per distinct evaluation text: coverage, similar training texts, and training records that hold them."""
        copies = self.training.groupBy(F.col("key").alias("t")).agg(F.count(F.lit(1)).alias("n"))
        linked = self.links.join(copies, "t").groupBy(F.col("e").alias("key")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("records"))
        return self.records.select("key", "coverage").join(linked, "key", "left").select(
            "key", "coverage", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("texts", "records"))
        )


def split_overlaps(training: DataFrame, evaluations: dict[str, DataFrame], id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """Pairs of a training record and an evaluation record with similarity >= ``threshold``.

    Returns ``(split, train_id, eval_id, similarity)``, one row per pair of ids and split.
    Records whose id is null or whose text is null or blank never count; repeated rows count once; an
    empty side gives no rows; other columns are ignored.
    """
    return Overlaps(training, evaluations, id_col, text_col, threshold, coverage=False).pairs()


def _sources(evaluations: dict[str, DataFrame], id_col: str, source_col: str) -> DataFrame:
    parts = [
        df.where(F.col(id_col).isNotNull()).select(F.lit(name).alias("split"), F.col(id_col).alias("id"), F.lower(F.trim(F.col(source_col))).alias("source"))
        for name, df in evaluations.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("split", "id").agg(F.min("source").alias("source"))


def coverage_records(found: Overlaps, evaluations: dict[str, DataFrame], id_col: str, source_col: str) -> DataFrame:
    """``(split, source, id, coverage, texts, records)`` per evaluation record; from class membership, no pair is expanded.

    ``coverage`` is the share of the words of the record's passages that training texts hold; null for a record without words.  A
    record that stands with several texts gets the greatest coverage and the sums of its texts' links.
    """
    per = found.evaluation.join(found.per_text(), "key").groupBy("split", "id").agg(
        F.max("coverage").alias("coverage"), F.sum("texts").alias("texts"), F.sum("records").alias("records")
    )
    out = _sources(evaluations, id_col, source_col).join(per, ["split", "id"], "left")
    return out.select("split", "source", "id", "coverage", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("texts", "records")))


def overlap_report(records: DataFrame) -> DataFrame:
    """:func:`coverage_records` per split and source: ``(split, source, eval_records, overlapping_records, pairs, mean_coverage)``.

    The source is trimmed and lower-cased; a null source is its own group.
    """
    return records.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("eval_records"),
        F.sum((F.col("records") > 0).cast("int")).cast("bigint").alias("overlapping_records"),
        F.sum("records").alias("pairs"),
        F.avg("coverage").alias("mean_coverage"),
    )
