"""The answer cache: a Parquet table keyed by answerer, model version, question-set hash and text hash.

An upsert keeps the new row, a merge keeps the old one; rows with an error count as answered.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.functions.scalar import sha256
from answerlab.session import Files

KEY = ["answerer", "model_version", "question_set_hash", "text_sha256"]
SCHEMA = (
    "answerer string, model_version string, question_set_hash string, text_sha256 string, complaint_id string, "
    "payload string, error string, input_tokens long, created_at string"
)


def first_per_text(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text, that of the least id; rows with null text are left out.

    A grouped minimum (combined before the shuffle), not a window: one text may be most of the table.
    """
    return (
        rows.where(F.col(text_col).isNotNull())
        .groupBy(sha256(F.col(text_col)).alias("text_sha256"))
        .agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).alias("r"))
        .select("text_sha256", F.col("r.id").alias(id_col), F.col("r.text").alias(text_col))
    )


def todo(rows: DataFrame, cache: DataFrame, answerer: str, model: str, questions: str, id_col: str = "complaint_id", text_col: str = "narrative") -> DataFrame:
    """Distinct texts that the cache has no row for, failed ones included in what it has."""
    have = cache.where((F.col("answerer") == answerer) & (F.col("model_version") == model) & (F.col("question_set_hash") == questions))
    return first_per_text(rows, id_col, text_col).join(have.select("text_sha256").distinct(), "text_sha256", "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``cache`` with the rows of ``new`` in place of those with the same key; keys must be unique in ``new``."""
    return cache.join(new.select(*key), key, "left_anti").unionByName(new)


def merge(cache: DataFrame, other: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``cache`` and the rows of ``other`` whose key it lacks."""
    return cache.unionByName(other.join(cache.select(*key), key, "left_anti"))


def lookup(cache: DataFrame, **key) -> DataFrame:
    """Rows with these key values."""
    for k, v in key.items():
        cache = cache.where(F.col(k) == v)
    return cache


def counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("answerer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").isNotNull().cast("int")).alias("failed"))


class AnswerCache:
    """A cache folder on any file system: each put appends a part; reading takes the newest row of a key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        if not any(n.startswith("part=") for n in Files(self.spark, self.path).names(self.path)):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA + ", part long").parquet(self.path)
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        # a grouped maximum, combined before the shuffle
        newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*cols), "part").alias("r"))
        return newest.select("r.*")

    def put(self, rows: DataFrame) -> None:
        """Append answered rows; they replace older rows of the same key."""
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        rows.select(*cols).write.option("compression", "zstd").parquet(f"{self.path}/part={time.time_ns()}")

    def backup(self, target: str) -> None:
        """Copy the folder; the copy is complete or absent."""
        files, new = Files(self.spark, target), f"{target.rstrip('/')}.new"
        files.delete(new)
        files.copy(self.path, new)
        files.delete(target)
        files.rename(new, target)

    @classmethod
    def open(cls, spark: SparkSession, path: str, backup: str | None = None) -> AnswerCache:
        """The cache at ``path``, restored from the backup only if it is missing."""
        if backup and not Files(spark, path).exists(path) and Files(spark, backup).exists(backup):
            Files(spark, path).copy(backup, path)
        return cls(spark, path)


class Backup:
    """Copies a cache at most every ``seconds``; :meth:`flush` copies at once."""

    def __init__(self, cache: AnswerCache, target: str, seconds: float = 300.0) -> None:
        self.cache, self.target, self.seconds, self.last = cache, target, seconds, time.monotonic()

    def tick(self) -> bool:
        if time.monotonic() - self.last < self.seconds:
            return False
        self.flush()
        return True

    def flush(self) -> None:
        self.cache.backup(self.target)
        self.last = time.monotonic()
