"""The pre-registration guard and the scoring log: git is asked through an injectable runner."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from answerlab.sources.tables import write_sheet

Runner = Callable[[list[str], str], tuple[int, str]]


class GuardError(RuntimeError):
    """Test labels may not be read yet."""


def git(args: list[str], cwd: str) -> tuple[int, str]:
    """(exit code, output) of a git command."""
    got = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True)
    return got.returncode, got.stdout.strip()


def after_tag(tag: str, cwd: str, run: Runner = git) -> bool:
    """Whether the tag exists and HEAD descends from it."""
    return run(["rev-parse", "-q", "--verify", f"refs/tags/{tag}"], cwd)[0] == 0 and run(["merge-base", "--is-ancestor", tag, "HEAD"], cwd)[0] == 0


def snapshot(cwd: str, run: Runner = git) -> dict:
    """Commit, whether the tree is dirty, and the hash of its difference."""
    dirty = bool(run(["status", "--porcelain"], cwd)[1])
    diff = run(["diff", "HEAD"], cwd)[1] if dirty else ""
    return {"commit": run(["rev-parse", "HEAD"], cwd)[1], "dirty": dirty, "diff_hash": hashlib.sha256(diff.encode()).hexdigest() if dirty else ""}


def load_test_labels(spark: SparkSession, path: str, tag: str, cwd: str, run: Runner = git) -> DataFrame:
    """The test labels, once the plan's tag is behind HEAD."""
    if not after_tag(tag, cwd, run):
        raise GuardError(f"test labels stay closed until {tag} is an ancestor of HEAD")
    return spark.read.parquet(path)


def append_scoring_log(path: str | Path, cwd: str, run: Runner = git) -> dict:
    """One row per scoring run, before anything is fitted, so that failed runs are logged too."""
    row = {"utc": datetime.now(UTC).isoformat(timespec="seconds")} | snapshot(cwd, run)
    write_sheet([row], path, ["utc", "commit", "dirty", "diff_hash"], append=True)
    return row
