"""Filling fixed-capacity containers with items, along a space-filling curve.

Each document's words are hashed and projected to a few dimensions; a Hilbert key of the point orders
the documents so that neighbours on the curve are alike.  The items are range-partitioned and sorted by
that key, and each partition packs its stretch of the curve: an item goes into the open container it
fills best, and the fullest container is closed when too many are open.  A text over the capacity
fills whole containers and leaves one remainder to be packed; no other item is divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm import textkernels as K
from answerlab.llm.tokens import DEFAULT_RANKS, encoding, ship_ranks
from answerlab.session import materialize

DIMENSIONS, BITS = 3, 10
_ITEMS = "array<struct<doc_id: {kind}, part: int, token_from: bigint, token_to: bigint>>"


def hilbert_key(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows, dimensions), by the transpose method."""
    x = point.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(texts: list[str | None], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of texts: hashed word vectors, projected, squashed to a grid."""
    out = []
    for s in K.shingle_texts(texts, 1):
        n = np.maximum(np.diff(s.first), 1)
        point = np.empty((len(n), dimensions))
        for k in range(dimensions):
            # a word's coordinate is a fixed pseudo-random number of mean 0 and variance 1
            unit = (K.mix64(s.words + np.uint64(k + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            total = np.concatenate(([0.0], np.cumsum((unit - 0.5) * np.sqrt(12.0))))
            point[:, k] = (total[s.first[1:]] - total[s.first[:-1]]) / np.sqrt(n)
        grid = (0.5 + 0.5 * np.tanh(point / 2)) * ((1 << bits) - 1)
        out.append(hilbert_key(np.clip(grid, 0, (1 << bits) - 1).astype(np.int64), bits))
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Packer:
    """Best fit over a bounded number of open containers."""

    def __init__(self, capacity: int, open_limit: int) -> None:
        self.capacity, self.open_limit = capacity, open_limit
        self.room: list[tuple[int, int]] = []  # (room left, container), ascending
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, size: int, item: tuple) -> tuple[int, list[tuple]] | None:
        """Place an item; returns a closed container (used, items) if one had to be closed."""
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, box = self.room.pop(at)
        else:
            left, box = self.capacity, self.next
            self.next += 1
            self.held[box] = []
        self.held[box].append(item)
        insort(self.room, (left - size, box))
        if self.room[0][0] == 0 or len(self.room) > self.open_limit:
            left, box = self.room.pop(0)
            return self.capacity - left, self.held.pop(box)
        return None

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        for left, box in self.room:
            yield self.capacity - left, self.held.pop(box)
        self.room = []


def pack_documents(
    table: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 512,
    ranks: str = DEFAULT_RANKS,
    open_limit: int = 256,
    partitions: int | None = None,
) -> DataFrame:
    """One row per container: ``(container_id, n_items, used, fill, items)``.

    An item is (document, part, first token, end token).  Every text that is not null is placed; an empty
    one takes no room.  Repeated rows are separate items; null ids are kept; other columns are ignored.
    Each partition of the curve leaves at most ``open_limit`` containers that are not full.
    """
    ship_ranks(table.sparkSession, ranks)
    rows = table.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(projected(texts), pa.int64()), pa.array(size, pa.int64())], ["doc_id", "curve", "size"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 36, 0
        packer = Packer(capacity, open_limit)
        done: list[tuple[int, list[tuple]]] = []

        def rows_of(boxes: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            nonlocal seq
            ids = [base + seq + i for i in range(len(boxes))]
            seq += len(boxes)
            flat = [x for _, items in boxes for x in items]
            cols = list(zip(*flat))
            struct = pa.StructArray.from_arrays(
                [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                ["doc_id", "part", "token_from", "token_to"],
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(i) for _, i in boxes]))), pa.int32())
            used = [u for u, _ in boxes]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(i) for _, i in boxes], pa.int32()),
                    pa.array(used, pa.int32()),
                    pa.array([u / capacity for u in used], pa.float64()),
                    pa.ListArray.from_arrays(offsets, struct),
                ],
                ["container_id", "n_items", "used", "fill", "items"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, size in zip(batch.column("doc_id").to_pylist(), batch.column("size").to_pylist()):
                whole = size // capacity if size > capacity else 0
                done += [(capacity, [(doc, k + 1, k * capacity, (k + 1) * capacity)]) for k in range(whole)]
                left = size - whole * capacity
                if left or not whole:
                    closed = packer.add(left, (doc, whole + 1, whole * capacity, size))
                    if closed:
                        done.append(closed)
            if len(done) > 5_000:
                yield rows_of(done)
                done = []
        done += packer.rest()
        if done:
            yield rows_of(done)

    count = partitions or rows._jdf.queryExecution().toRdd().getNumPartitions()
    # written once: the range partitioning samples its input before it shuffles it
    sized = materialize(rows.mapInArrow(measure, f"doc_id {kind}, curve long, size long"))
    # the id breaks ties, so that copies of one text, however many, spread over the ranges
    ordered = sized.repartitionByRange(count, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.mapInArrow(pack, f"container_id long, n_items int, used int, fill double, items {_ITEMS.format(kind=kind)}")


def fill_report(containers: DataFrame) -> DataFrame:
    """One row: containers, items, tokens, mean fill, share of containers filled to 99 %."""
    return containers.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("items"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("bigint").alias("tokens"),
        F.avg("fill").alias("mean_fill"),
        F.avg((F.col("fill") >= 0.99).cast("int")).alias("share_full"),
    )
