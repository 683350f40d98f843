"""Snapshots of the engine's tables: one folder per revision, and a manifest that names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry import schemas


class SnapshotStore:
    """Tables as Parquet under root/<snapshot>/<table>. A refresh writes a new
    snapshot and then the manifest, in that order, so readers see the old tables or
    the new ones. The manifest is a one-row table itself, so any store that Spark
    writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> dict:
        try:
            rows = self.spark.read.text(f"{self.root}/_manifests").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {"snapshot": None, "number": 0, "schema_version": schemas.SCHEMA_VERSION}
            raise
        best = max((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])
        if best["schema_version"] > schemas.SCHEMA_VERSION:
            raise ValueError(f"tables of a later version: {best['schema_version']}")
        return best

    def read(self, table: str) -> DataFrame:
        snapshot = self.manifest()["snapshot"]
        if snapshot is None or table not in self.manifest()["tables"]:
            return self.spark.createDataFrame([], schemas.SCHEMAS[table])
        return self.spark.read.schema(schemas.SCHEMAS[table]).parquet(f"{self.root}/{snapshot}/{table}")

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A new snapshot of these tables; others are taken over from the current one."""
        old = self.manifest()
        snapshot = f"snap-{uuid.uuid4().hex[:12]}"
        every = {n: self.read(n) for n in old.get("tables", [])} | tables
        for name, df in every.items():
            cols = [c.split()[0] for c in schemas.SCHEMAS[name].split(", ")]
            df.select(*cols).write.parquet(f"{self.root}/{snapshot}/{name}")
        row = {"snapshot": snapshot, "number": old["number"] + 1, "schema_version": schemas.SCHEMA_VERSION, "tables": sorted(every)}
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/_manifests")
        return snapshot

    def clear(self) -> None:
        self.write({n: self.spark.createDataFrame([], s) for n, s in schemas.SCHEMAS.items()})
