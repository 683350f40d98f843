"""Debounced file changes: sessions of events per path, suppressed repeats, streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, quiet: str, watermark: str | None = None) -> DataFrame:
    """events: ts (timestamp), path. One row per run of events of a path without a
    gap of quiet: path, events, started, ended. With a watermark it runs on streams."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    runs = rows.groupBy("path", F.session_window("ts", quiet)).agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return runs.select("path", "events", "started", "ended")


def batches(events: DataFrame, quiet: str) -> DataFrame:
    """Sorted distinct paths of each run of events over all paths, split by windows of ten times quiet."""
    runs = events.groupBy(F.session_window("ts", quiet)).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return runs.select(F.col("session_window.start").alias("started"), "paths")


def changed_only(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Events whose value differs from the one before of the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def changed_stream(events: DataFrame) -> DataFrame:
    """events: path, kind (create, modify, remove), hash. As a stream: creations and
    removals pass, modifications only if the path's hash is new; state is a hash per path."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for frame in frames:
            for kind, digest in zip(frame["kind"], frame["hash"]):
                if kind != "modify" or digest != last:
                    out.append((key[0], kind, digest))
                last = None if kind == "remove" else digest
        state.update((last,))
        yield pd.DataFrame(out, columns=["path", "kind", "hash"])

    return events.groupBy("path").applyInPandasWithState(step, "path string, kind string, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def refresh(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Runs apply(paths, batch) for every micro-batch of changed paths; returns the started query."""
    return changes.writeStream.foreachBatch(lambda d, k: apply(d.select("path").distinct(), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
