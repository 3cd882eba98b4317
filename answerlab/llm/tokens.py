"""Token counts by a public tokenizer's ranks; the file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SHIPPED: set[tuple[str, str]] = set()


def ship_ranks(spark: SparkSession, path: str) -> None:
    """Send the rank file to the executors, once per application; only the driver needs it at its path."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _SHIPPED:
        _SHIPPED.add((context.applicationId, path))
        context.addFile(path)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, as shipped or at its path; kept once per Python worker."""
    sent = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path)) if SparkFiles._is_running_on_worker else ""
    with open(sent if os.path.exists(sent) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = DEFAULT_RANKS) -> int:
    return len(encoding(path).encode_ordinary(text))


def with_token_counts(table: DataFrame, text_col: str, keep: list[str], path: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (null for null texts)."""
    ship_ranks(table.sparkSession, path)
    rows = table.select(*keep, F.col(text_col).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*kept, "n_tokens long"]))
