"""Scans by key in a total order, pages of a result, and merges in which the first row wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.schemas import SQL_LIMIT, checked_limit

#: The order of the rows of one file.
ORDERS = {"facts": ["line", "fact_type", "value", "id"], "callsites": ["line", "target", "id"], "aliases": ["line", "local_name", "imported_name", "id"]}


def of_file(rows: DataFrame, table: str, file: str) -> DataFrame:
    return rows.where(F.col("file") == file).orderBy(*ORDERS[table])


def edges_by(edges: DataFrame, *, source: int | None = None, target: int | None = None, name: str | None = None) -> DataFrame:
    """The edges that leave source, reach target, or name a target, whichever are given."""
    for column, value in (("source_id", source), ("target_id", target), ("target_name", name)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def line_contains(lines: DataFrame, file: str, line: int, needle: str) -> DataFrame:
    """One row, found: whether that line holds needle; false without such a line."""
    at = lines.where((F.col("file") == file) & (F.col("line") == line))
    return at.agg(F.coalesce(F.bool_or(F.contains("text", F.lit(needle))), F.lit(False)).alias("found"))


def callsites_matching(calls: DataFrame, callee: str, limit: int, file_part: str | None = None) -> DataFrame:
    """Call sites of a name: as callee or target, at the end of the target, or within the
    callee. Resolved ones come first, those of Go test files last."""
    hit = (F.col("callee") == callee) | (F.col("target") == callee) | F.col("target").ilike(f"%{callee}") | F.col("callee").ilike(f"%{callee}%")
    rows = calls.where(hit)
    if file_part is not None:
        rows = rows.where(F.col("file").ilike(f"%{file_part}%"))
    return rows.orderBy(F.col("resolved_id").isNull(), F.col("file").endswith("_test.go"), "file", "line", "target", "id").limit(min(limit, SQL_LIMIT))


def named_like(symbols: DataFrame, pattern: str, limit: int, file: str | None = None) -> DataFrame:
    """Symbols whose name has the caller's LIKE pattern, in any case; file is a whole path or its end."""
    rows = symbols.where(F.col("name").ilike(pattern))
    if file is not None:
        rows = rows.where((F.col("file") == file) | F.col("file").ilike(f"%/{file}"))
    return rows.orderBy("file", "line", "name", "id").limit(checked_limit(limit))


def method_suffix(symbols: DataFrame, name: str, file: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols of which name is the last dotted part."""
    return named_like(symbols, f"%.{name}", SQL_LIMIT if file is not None else limit, file)


def page(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first limit rows, each with truncated: whether more follow. One row more is read."""
    more = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # limit + 1 rows
    total = F.count("*").over(Window.partitionBy())
    return more.select("*", place.alias("_place"), (total > limit).alias("truncated")).where(F.col("_place") <= limit).drop("_place")


def continuation(tool: str, truncated: bool, returned: int, omitted: int) -> dict | None:
    if not truncated:
        return None
    return {"cursor": f"{tool}:offset:{returned}", "omitted": omitted, "next_request_hint": f"ask more narrowly or inspect the handles; {tool} bounds its answers"}


def merged(parts: list[DataFrame], key: list[str], order: list[Column | str]) -> DataFrame:
    """The parts one after another; of rows with the same key the first stays."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("_part", *order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_part")
