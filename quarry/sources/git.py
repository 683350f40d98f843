"""Commit histories as rows of (idx, file)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from quarry import schemas

_MARK = "---COMMIT---"


def parse_log(text: str, extensions: list[str] | None = None) -> list[tuple[int, str]]:
    """idx counts the marks, so the newest commit has 1; files of other kinds are left out."""
    rows, idx = [], 0
    for line in map(str.strip, text.splitlines()):
        if line == _MARK:
            idx += 1
        elif line and (extensions is None or line.rsplit(".", 1)[-1] in extensions):
            rows.append((idx, line.replace("\\", "/")))
    return rows


def commits(spark: SparkSession, root: str, *, most: int = schemas.MAX_COMMITS, timeout: float = 30.0, extensions: list[str] | None = None) -> DataFrame:
    """The last commits of a repository; none if git takes too long, an error if it fails."""
    try:
        log = subprocess.run(["git", "-C", root, "log", "--name-only", f"--max-count={most}", f"--pretty=format:{_MARK}"], capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return spark.createDataFrame([], "idx long, file string")
    if log.returncode:
        raise RuntimeError(log.stderr.strip() or "git log failed")
    return spark.createDataFrame(parse_log(log.stdout, extensions), "idx long, file string")
