"""Near-duplicate records with small edits: MinHash LSH forest with exact verification.

Every distinct text gets a label of ``DEPTH`` MinHash values in each of ``TREES`` trees; the digits of different trees
are different permutations, so trees are independent.  Labels of a tree are sorted, and runs of equal prefixes are the nodes of its
trie.  In each tree a text is compared inside the shallowest node that holds at most ``node_limit`` texts: its matched
prefix is shortened from the full label as long as the node stays that small, at most to ``FLOOR`` values.  The recall of a
text's partners at the threshold, ``1 - prod(1 - s ** depth)`` over its trees, follows from the prefix lengths used;
texts below the target go through further trees with fresh permutations, until all reach it.  Candidates are
screened by 96-bit sketches where they arise and by all values of their labels afterwards; the loss is part of the
estimate.  What is left is verified exactly.

Hot nodes.  A sketch of fixed size counts the nodes of all labels beforehand.  A node that holds too large a share of a tree
is not gathered: its texts are sent on by their full labels, and a full label that is shared by more than
``BLOCK`` texts is cut into blocks, each pair of which is a task of its own.  Nothing is dropped for being popular.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import textkernels as K
from answerlab.llm.counting import total_counts
from answerlab.llm.similarity import components, sets_for, verify_pairs
from answerlab.session import materialize, semi_join_checked, spread

TREES, FLOOR, DEPTH = 20, 3, 5
#: Texts whose labels share this share of a tree at the shortest prefix are sent on by their full labels.
HOT_SHARE = 1 / 256
#: Texts of one full label that a task compares at once; more are cut into blocks.
BLOCK = 8_192
_COUNTERS = 1 << 16
#: Sigmas by which a pair at the threshold may miss the screen, and the chance that it does.
DEVIATIONS, SCREEN_LOSS = 3.5, 0.0005
_TEXT = np.dtype([("key", "<i8"), ("first", "<u8"), ("more", "<u4"), ("digits", "<u4", (TREES * DEPTH,))])
#: One label in a shard: its node, its next two digits, how it is compared, the sketch, the text.
_ROW = np.dtype([("node", "<u4"), ("d4", "<u2"), ("d5", "<u2"), ("mode", "u1"), ("more", "<u4"), ("first", "<u8"), ("key", "<i8")])
_TRIE, _FULL, _LEFT, _RIGHT = range(4)
_PAIRS = 1 << 21


def recall_at(similarity: float, depths: list[int]) -> float:
    """Chance that two texts of that similarity share a node of these depths in some tree."""
    return 1 - math.prod(1 - similarity**d for d in depths)


def _nodes(digits: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one tree's shortest prefixes and full labels."""
    node = np.full(len(digits), tree + 1, np.uint64)
    short = node
    for d in range(DEPTH):
        node = K.mix64(node * np.uint64(0x9E3779B97F4A7C15) + digits[:, tree * DEPTH + d])
        if d + 1 == FLOOR:
            short = node
    return short, node


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def labelled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``(id, text)`` to ``(ids, id_keys, labels)``: batches of rows with their content keys, and the labels of the texts among them.

    In a task a text's label comes once.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at, keys, labels = [], [], []
            for s in K.shingle_texts(batch.column("text").to_pylist(), n):
                k, live = K.content_keys(s.words, s.first), np.flatnonzero(np.diff(s.first) > 0)
                at.append(live + s.start)
                keys.append(k[live])
                fresh = np.array([i for i in live.tolist() if k[i] not in seen and not seen.add(k[i])], np.int64)
                size = np.diff(s.offsets)[fresh]
                sig = K.minhash(s.hashes[K.ranges(s.offsets[fresh], size)], np.concatenate(([0], np.cumsum(size))), TREES * DEPTH, seed)
                text = np.empty(len(fresh), _TEXT)
                text["key"], text["digits"] = k[fresh], sig
                text["first"], text["more"] = K.bit_sketch(sig[:, : K.SKETCH_BITS])
                labels.append(text.tobytes())
            if at:
                where, keys_ = np.concatenate(at), np.concatenate(keys)
                ids = batch.column("id").take(pa.array(where))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([keys_], pa.list_(pa.int64())),
                        pa.array([b"".join(labels)], pa.binary()),
                    ],
                    ["ids", "id_keys", "labels"],
                )

    return rows.select("id", "text").mapInArrow(run, f"ids array<{kind}>, id_keys array<long>, labels binary")


def node_counts(labels: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(texts by counter of the shortest prefixes, of the full labels, texts) over all labels; of fixed size on the driver."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for blob in batch.column("labels"):
            text = np.frombuffer(blob.as_py(), _TEXT)
            total[-1] += len(text)
            for tree in range(TREES):
                short, full = _nodes(text["digits"], tree)
                total[:_COUNTERS] += np.bincount(_counter(short), minlength=_COUNTERS)
                total[_COUNTERS:-1] += np.bincount(_counter(full), minlength=_COUNTERS)

    total = total_counts(labels.select("labels"), 2 * _COUNTERS + 1, count)
    return total[:_COUNTERS], total[_COUNTERS:-1], int(total[-1])


def _routed(text: np.ndarray, tree: int, short_n: np.ndarray, full_n: np.ndarray, hot: float, block: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, shards) of one tree's labels."""
    short, full = _nodes(text["digits"], tree)
    row = np.empty(len(text), _ROW)
    for c in ("more", "first", "key"):
        row[c] = text[c]
    row["d4"] = (K.mix64(text["digits"][:, tree * DEPTH + FLOOR]) & np.uint64(0xFFFF)).astype(np.uint16)
    row["d5"] = (full & np.uint64(0xFFFF)).astype(np.uint16)
    deep = short_n[_counter(short)] > hot
    node = np.where(deep, full, short)
    row["mode"] = np.where(deep, _FULL, _TRIE)
    row["node"] = (node >> np.uint64(16)).astype(np.uint32)
    shard = (K.mix64(node) % np.uint64(count)).astype(np.int32)
    parts = np.where(deep, -(-full_n[_counter(full)] // block), 1)
    once = parts <= 1
    yield row[once], shard[once]
    for m in np.unique(parts[~once]).tolist():  # blocks: every pair of parts is a node of its own
        some = np.flatnonzero(parts == m)
        mine = (K.mix64(row["key"][some].view(np.uint64)) % np.uint64(m)).astype(np.int64)
        for other in range(m):
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            copy = row[some].copy()
            own = K.mix64(full[some] + (i * m + j + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            copy["node"] = (own >> np.uint64(16)).astype(np.uint32)
            copy["mode"] = np.where(i == j, _FULL, np.where(mine == i, _LEFT, _RIGHT))
            yield copy, (own % np.uint64(count)).astype(np.int32)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in sorted columns, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), len(new))


def _spread_over(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.diff(bounds), np.diff(bounds))


def _screened(rows: np.ndarray, ahead: np.ndarray, least: int, gap: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of keys of each row with the ``ahead`` rows after it (``gap`` rows further on) whose sketches agree."""
    first, more, key = rows["first"], rows["more"], rows["key"]
    edge = np.concatenate(([0], np.cumsum(ahead)))
    lo = 0
    while lo < len(ahead):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _PAIRS, side="right")) - 1)
        n = ahead[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(edge[lo:hi] - edge[lo], n)
        if gap is not None:
            j += np.repeat(gap[lo:hi], n)
        differ = np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(more[i] ^ more[j])
        ok = (differ <= K.SKETCH_BITS - least) & (key[i] != key[j])
        a, b = key[i[ok]], key[j[ok]]
        yield np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)
        lo = hi


def candidates(labels: DataFrame, threshold: float, node_limit: int, shards: int, block: int = BLOCK, hot_share: float = HOT_SHARE) -> DataFrame:
    """One forest over :func:`labelled` rows: ``(a, b, depth)``.

    Rows with ``b`` are screened candidate pairs a < b (a pair may come once per tree and shard).  Rows
    without ``b`` say that text ``a`` was compared in a node of ``depth`` values, more than the shortest prefix.
    """
    short_n, full_n, texts = node_counts(labels)
    hot = max(node_limit, texts * hot_share)
    least = K.sketch_limit(threshold, DEVIATIONS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("labels"):
                text = np.frombuffer(blob.as_py(), _TEXT)
                got = [x for tree in range(TREES) for x in _routed(text, tree, short_n, full_n, hot, block, shards)]
                rows, where = np.concatenate([r for r, _ in got]), np.concatenate([s for _, s in got])
                order = np.argsort(where, kind="stable")
                rows, cut = rows[order], np.searchsorted(where[order], np.arange(shards + 1))
                used = np.flatnonzero(np.diff(cut))
                offsets = pa.py_buffer((np.append(cut[used], cut[-1]) * _ROW.itemsize).astype(np.int64))
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(used), [None, offsets, pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), blobs.cast(pa.binary())], ["shard", "rows"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("rows").to_pylist()]
        if not blobs:
            return
        rows = np.frombuffer(b"".join(blobs), _ROW)
        del blobs
        # copies of a text that several tasks labelled come together and are merged
        rows = rows[np.lexsort((rows["key"], rows["d5"], rows["d4"], rows["mode"], rows["node"]))]
        same = np.zeros(len(rows), bool)
        same[1:] = True
        for c in ("node", "mode", "d4", "d5", "key"):
            same[1:] &= rows[c][1:] == rows[c][:-1]
        rows = rows[~same]
        trie, full = rows[rows["mode"] == _TRIE], rows[rows["mode"] == _FULL]
        # the sorted labels: nodes of three, four and five values
        bounds = [_runs(*(trie[c] for c in cs)) for cs in (("node",), ("node", "d4"), ("node", "d4", "d5"))]
        size = [_spread_over(b) for b in bounds]
        depth = np.where(size[0] <= node_limit, FLOOR, np.where(size[1] <= node_limit, FLOOR + 1, DEPTH))
        ends = [np.repeat(b[1:], np.diff(b)) for b in bounds]
        end = np.where(depth == FLOOR, ends[0], np.where(depth == FLOOR + 1, ends[1], ends[2]))
        found = _screened(trie, end - np.arange(len(trie)) - 1, least)
        yield from (_batch(p) for p in found)
        whole = _runs(full["node"])
        yield from (_batch(p) for p in _screened(full, np.repeat(whole[1:], np.diff(whole)) - np.arange(len(full)) - 1, least))
        # blocks: the left rows of a node, then the right ones
        both = rows[rows["mode"] >= _LEFT]
        left = both["mode"] == _LEFT
        node = _runs(both["node"])
        n_left = np.add.reduceat(left, node[:-1]) if len(both) else np.empty(0, np.int64)
        stop = np.repeat(node[:-1] + n_left, np.diff(node))
        ahead = np.where(left, np.repeat(np.diff(node) - n_left, np.diff(node)), 0)
        yield from (_batch(p) for p in _screened(both, ahead, least, np.maximum(stop - np.arange(len(both)) - 1, 0)))
        # a text of a node cut into blocks is counted by its diagonal block alone
        lost = np.concatenate([trie["key"][depth > FLOOR], full["key"]])
        at = np.concatenate([depth[depth > FLOOR], np.full(len(full), DEPTH)])
        yield pa.RecordBatch.from_arrays([pa.array(lost), pa.nulls(len(lost), pa.int64()), pa.array(at, pa.int32())], ["a", "b", "depth"])

    sent = labels.select("labels").mapInArrow(route, "shard int, rows binary")
    return sent.repartitionById(shards, "shard").mapInArrow(match, "a long, b long, depth int")


def _batch(pairs: np.ndarray) -> pa.RecordBatch:
    if len(pairs):
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))]
    a, b = (np.ascontiguousarray(pairs[:, i]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32())], ["a", "b", "depth"])


def _screened_again(pairs: DataFrame, labels: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` whose labels agree in as many values as those of pairs at the threshold do; a byte a value is compared."""
    width = TREES * DEPTH
    least = math.floor(width * threshold - DEVIATIONS * math.sqrt(width * threshold * (1 - threshold)))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("labels"):
                text = np.frombuffer(blob.as_py(), _TEXT)
                low = (K.mix64(text["digits"].ravel()) & np.uint64(0xFF)).astype(np.uint8)
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(text), [None, pa.py_buffer(low.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(text["key"])), values.cast(pa.binary())], ["key", "marks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("x", "y"))
            keep = pa.array(np.flatnonzero((x == y).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    known = semi_join_checked(labels.select("labels").mapInArrow(marks, "key long, marks binary"), keys, "key").dropDuplicates(["key"])
    left = known.select(F.col("key").alias("a"), F.col("marks").alias("x"))
    right = known.select(F.col("key").alias("b"), F.col("marks").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _keys_of(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())


class Forest:
    """The forest over ``(id, text)`` rows and what it found.

    ``members``: ``(id, key)`` of every row that counts; ``pairs``: ``(a, b, similarity)`` between distinct texts;
    ``rounds``: per round of trees, ``(round, depth, labels)`` as rows of (round, depth, number of labels compared at that prefix length).
    """

    def __init__(
        self, table: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, target_recall: float = 0.99, n: int = 5, node_limit: int = 256,
        max_rounds: int = 16, block: int = BLOCK, hot_share: float = HOT_SHARE,
    ) -> None:
        rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
        labels = every = materialize(labelled(rows, n, 1))
        pair = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("id_keys").alias("key"))).alias("x")
        self.members = labels.select(pair).select("x.id", "x.key").distinct()
        shards, base = spread(rows), TREES * math.log1p(-(threshold**FLOOR))
        goal = math.log(max(1e-9, 1 - target_recall - SCREEN_LOSS))
        if base > goal:
            raise ValueError(f"{TREES} trees of {FLOOR} values reach a recall of {1 - math.exp(base):.3f}, not {target_recall}")
        gain = F.when(F.col("depth") == FLOOR + 1, math.log1p(-(threshold ** (FLOOR + 1)))).otherwise(math.log1p(-(threshold**DEPTH)))
        found, missing, self.rounds = None, None, []
        for r in range(1, max_rounds + 1):
            out = materialize(candidates(labels, threshold, node_limit, shards, block, hot_share))
            pairs = out.where("b is not null").select("a", "b")
            found = pairs if found is None else found.unionByName(pairs)
            deep = out.where("b is null")
            # what a text's longer prefixes leave to be missed, over all rounds so far
            now = deep.groupBy(F.col("a").alias("key")).agg((F.sum(gain) - F.count(F.lit(1)) * math.log1p(-(threshold**FLOOR)) + base).alias("log_miss"))
            # a text that lost nothing in a later round has all its trees at the shortest prefix
            missing = now if missing is None else missing.join(now.withColumnRenamed("log_miss", "_more"), "key", "left").select(
                "key", (F.col("log_miss") + F.coalesce("_more", F.lit(base))).alias("log_miss")
            )
            missing = materialize(missing)
            self.rounds.append((r, deep))
            if missing.where(F.col("log_miss") > goal).isEmpty():
                break
            # their partners were in the same deep nodes, so every text that lost anything takes part
            lost = materialize(missing.select("key"))
            ids = materialize(semi_join_checked(self.members, lost, "key").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct())
            labels = materialize(labelled(semi_join_checked(rows, ids, "id"), n, r + 1))
        else:
            raise RuntimeError(f"the target recall is not reached in {max_rounds} rounds of trees")
        found = materialize(found.distinct())
        found = materialize(_screened_again(found, every, _keys_of(found), threshold))
        self.pairs = materialize(verify_pairs(found, sets_for(rows, self.members, _keys_of(found)), threshold))

    def prefix_lengths(self) -> DataFrame:
        """``(round, depth, labels)``: how many labels were compared at each prefix length beyond the shortest."""
        parts = [deep.groupBy("depth").agg(F.count(F.lit(1)).alias("labels")).select(F.lit(r).alias("round"), "depth", "labels") for r, deep in self.rounds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def near_duplicate_pairs(table: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, **forest) -> DataFrame:
    """All pairs of different ids with similarity of at least ``threshold``, as ``(id_a, id_b)``, a < b.

    Copies of a text are expanded into all their pairs; see :func:`near_duplicate_groups` for
    the form without that.  Rows with a null id, or a null or blank text, never count; repeated rows
    count once; an empty table gives no rows; other columns are ignored.
    """
    got = Forest(table, id_col, text_col, threshold, **forest)
    similar = got.pairs.select("a", "b")
    copied = got.members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    needed = materialize(similar.select(F.col("a").alias("key")).union(similar.select("b")).union(copied).distinct())
    members = materialize(semi_join_checked(got.members, needed, "key"))
    links = similar.union(copied.select(F.col("key").alias("a"), F.col("key").alias("b")))
    left = members.select(F.col("key").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("key").alias("b"), F.col("id").alias("y"))
    return (
        links.join(left, "a")
        .join(right, "b")
        .where("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def near_duplicate_groups(table: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, **forest) -> DataFrame:
    """One row per id and text: ``(id, class_id, n_links)``.

    ``class_id`` is the least id of the group of versions, ``n_links`` the number of other distinct texts
    the row's text is similar to.  Copies share a class without being expanded into pairs.  Rows
    with a null id or a null or blank text are left out.
    """
    got = Forest(table, id_col, text_col, threshold, **forest)
    similar = got.pairs.select("a", "b")
    degree = similar.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    classes = components(similar).select(F.col("node").alias("key"), F.col("class_id").alias("root"))
    tagged = (
        got.members.join(degree, "key", "left")
        .join(classes, "key", "left")
        .select(
            "id",
            F.coalesce("root", "key").alias("root"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )
    )
    least = tagged.groupBy("root").agg(F.min("id").alias("class_id"))
    return tagged.join(least, "root").select("id", "class_id", "n_links")
