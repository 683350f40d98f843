"""What the corpus operators share: the shared folder, staged tables, Arrow batching."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: blank and U+0009 to U+000D.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of this machine; on a
    cluster that would lose rows, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{os.getuid()}"


#: Shuffle files of a write that has ended are of no more use: what it wrote is read instead.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Staged tables of one operator, each written to the shared folder and read
    again: lineage ends there, so a lost executor costs no more than the step
    that reads it. drop() deletes tables that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark)
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = path
        return read

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again (see Scratch)."""
    return Scratch(df.sparkSession).keep(df, label)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def frugal(run: Callable) -> Callable:
    """run, a function of Arrow batches, whose worker gives back what it does not need when the
    last batch is done: workers wait for further tasks beside an executor's other stages."""

    def inner(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            from quarry.llm._words import Rolling

            Rolling.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def arrow_rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, converted a slice at a time so that
    a batch of long texts is not held twice."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.slice(at, 512).to_pylist() for c in cols))


def slices(batch, name: str, most: int = 1_000_000) -> Iterator:
    """An Arrow batch in slices of about so many bytes of the column name (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    turn = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_batches(batches: Iterable, names: tuple[str, str] = ("doc_id", "text"), chars: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of about so many characters of text."""
    some, held = [], 0
    for row in arrow_rows(batches, *names):
        some.append(row)
        held += len(row[1])
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some
