"""Line scans and bounded slices of source text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import identifier_terms, line_pattern


def line_match(query: str) -> Column:
    """exact_phrase, ordered_tokens, or null."""
    low = F.lower("text")
    kind = F.when(F.contains(low, F.lit(query.strip().lower())), "exact_phrase")
    terms = identifier_terms(query)
    return kind.when(low.rlike(".*".join(map(re.escape, terms))), "ordered_tokens") if len(terms) >= 2 else kind


def scan(lines: DataFrame, query: str) -> DataFrame:
    """lines: file, line, text. The lines that match, and how; nothing for less than three characters."""
    if len(query.strip()) < 3 and not identifier_terms(query):
        return lines.withColumn("match", F.lit(None).cast("string")).limit(0)
    found = lines.where(F.col("text").rlike("(?i)" + line_pattern(query)))
    return found.withColumn("match", line_match(query)).where("match is not null")


def ranked_scan(lines: DataFrame, query: str, limit: int) -> DataFrame:
    """Phrases before ordered terms, sources before tests, then file and line."""
    rows = scan(lines, query)
    points = F.when(F.col("match") == "exact_phrase", 10).otherwise(4) + F.when(F.col("file").startswith("src/"), 1).otherwise(0) - F.when(F.col("file").contains("test"), 1).otherwise(0)
    return rows.withColumn("points", points.cast("long")).orderBy(F.desc("points"), "file", "line").limit(limit)


def snippet(lines: DataFrame, spans: DataFrame, chars: int) -> DataFrame:
    """spans: file, first, last. Per span the lines within it up to chars
    characters (line ends counted), cut within a line; truncated tells if so."""
    spans = spans.distinct()
    rows = lines.join(spans, "file").where("line between first and last")
    w = Window.partitionBy("file", "first", "last").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(F.length("text") + 1).over(w)).withColumn("room", chars - (F.col("upto") - F.length("text") - 1))
    kept = rows.where("room > 0").withColumn("part", F.expr("substring(text, 1, cast(room as int))"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n")
    return kept.groupBy("file", "first", "last").agg(text.alias("text"), F.max("line").alias("end_line"), (F.max("upto") - 1 > chars).alias("truncated"))


def secret_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold a marker of a secret."""
    return lines.where(F.lower("text").rlike("|".join(SECRET_MARKERS)))


# Markers of secrets.
SECRET_MARKERS = ["secret", "password", "passwd", "token", "api_key", "apikey", "access_key", "private_key", "authorization", "credential", "bearer"]
