"""Exact similarity of candidate pairs, and the groups that similar pairs form.

Pairs are between *content keys* (one per distinct text), so copies of a text cost nothing here;
they come back by joining the membership table ``(id, key)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import textkernels as K
from answerlab.session import materialize, semi_join_checked, small_enough


def shingle_sets(rows: DataFrame, n: int = 5) -> DataFrame:
    """Rows with a ``text`` to ``(key, shingles)``: content keys and the sorted distinct 64-bit shingle hashes as bytes.

    Texts without words have no row; copies inside a task come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys: list[int] = []
            out: list[bytes] = []
            for s in K.shingle_texts(batch.column("text").to_pylist(), n):
                live = np.diff(s.first) > 0
                for i, k in enumerate(K.content_keys(s.words, s.first).tolist()):
                    if live[i] and k not in seen:
                        seen.add(k)
                        keys.append(k)
                        out.append(K.distinct_sorted(s.hashes, s.offsets, i).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "shingles"])

    return rows.select("text").mapInArrow(run, "key long, shingles binary")


def rows_of(rows: DataFrame, owners: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows ``(id, text)`` of one id for each of ``keys``, by ``owners (id, key)``.

    ``keys`` should be materialised: it is counted, and bounds the ids; both are broadcast only below ``BROADCAST_ROWS``.
    """
    sent = F.broadcast if small_enough(keys) else lambda df: df
    ids = owners.join(sent(keys.select("key")), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    return rows.select("id", "text").join(sent(ids), "id", "left_semi")


def sets_for(rows: DataFrame, owners: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, shingles)`` of the texts of ``keys``; see :func:`rows_of`.  Only the rows needed reach Python."""
    return semi_join_checked(shingle_sets(rows_of(rows, owners, keys)), keys, "key").dropDuplicates(["key"])


def verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of keys whose similarity is at least ``threshold``, as ``(a, b, similarity)``.

    ``sets`` has one row per key.  Each pair carries two shingle sets for the length of one
    task; the pairs must be distinct candidates, not all pairs.
    """
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            sim = np.fromiter(
                (K.jaccard_sorted(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(sa, sb)),
                np.float64,
                len(sa),
            )
            keep = np.flatnonzero(sim >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(sim[keep])],
                ["a", "b", "similarity"],
            )

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges ``(a, b)``: one row ``(node, class_id)`` per node.

    ``class_id`` is the least node of the component.  Alternating large-star and small-star rounds
    (each a grouped minimum with map-side combining, no group is ever collected) reach the
    fixed point in a number of rounds that grows with the logarithm of the longest chain; each
    round's edges are written to the shared folder.  Without edges the result is empty.
    """
    now = materialize(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        small = materialize(small)
        same = small.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(small, ["u", "v"], "left_anti").isEmpty()
        now = small
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct()
    )
