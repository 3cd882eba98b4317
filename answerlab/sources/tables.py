"""Sources and sinks: typed CSV with header checks, Parquet, JSON, small CSV sheets, YAML, keyed vector caches."""

from __future__ import annotations

import csv
import glob
import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.config import REQUIRED_COLUMNS
from answerlab.functions.scalar import sha256


def csv_headers(path: str) -> list[str]:
    """Column names of one CSV file; a byte-order mark does not count."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        return next(csv.reader(f), [])


def read_export(spark: SparkSession, pattern: str, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """All files of a glob as one frame of strings; quoted line breaks and doubled quotes are kept apart.

    Columns are taken by position, so a file whose header differs from the first one's is refused, as is an export
    that lacks a required column.  Empty fields are null.
    """
    paths = sorted(glob.glob(pattern))
    if not paths:
        raise ValueError(f"no file matches {pattern}")
    header = csv_headers(paths[0])
    for p in paths[1:]:
        if csv_headers(p) != header:
            raise ValueError(f"{p}: header differs from {paths[0]}")
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"{paths[0]}: missing columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.csv(paths, schema=schema, header=True, sep=",", quote='"', escape='"', multiLine=True, enforceSchema=True)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to some columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_json(value, path: str | Path) -> None:
    """A small result of the driver, keys sorted."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def write_sheet(rows: list[dict], path: str | Path, columns: list[str], append: bool = False) -> None:
    """A small CSV sheet; appending writes the header only into a new file."""
    path = Path(path)
    fresh = not (append and path.exists())
    with path.open("a" if append else "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns)
        if fresh:
            out.writeheader()
        out.writerows(rows)


def read_sheet(path: str | Path) -> list[dict]:
    """A small CSV sheet that people edited, with or without a byte-order mark."""
    with Path(path).open(newline="", encoding="utf-8-sig") as f:
        return list(csv.DictReader(f))


def load_yaml(path: str | Path):
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def cached_vectors(spark: SparkSession, texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of ``(text)`` rows by a Parquet cache ``(text_sha256, vector)``: only new texts are embedded.

    ``embed`` maps distinct ``(text_sha256, text)`` rows to ``(text_sha256, vector)``.
    """
    wanted = texts.where("text is not null").select(sha256(F.col("text")).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])
    try:
        have = spark.read.parquet(path)
        wanted = wanted.join(have.select("text_sha256"), "text_sha256", "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    embed(wanted).select("text_sha256", "vector").write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).dropDuplicates(["text_sha256"])
