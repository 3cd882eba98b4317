"""Counts over all rows in arrays of fixed size: each task counts its batches, the arrays are added on the executors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def total_counts(rows: DataFrame, size: int, count: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of an array of ``size`` numbers to which ``count`` adds each batch.

    The arrays of the tasks are added in two levels, so that no task reads more than about the root of their number; what
    reaches the driver is one array.
    """

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            count(batch, total)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield packed(total)

    parts = rows.mapInArrow(first, "counts binary")
    tasks = parts._jdf.queryExecution().toRdd().getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "counts binary")
    out = np.zeros(size, np.int64)
    for r in parts.repartition(1).mapInArrow(add, "counts binary").collect():  # one row
        out += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out
