"""Order of evidence: lines of a file, paths, matched lines; the checklist of an answer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a question that are no evidence.
STOP_WORDS = ["where", "what", "which", "when", "does", "give", "find", "line", "file", "each", "list", "method", "function", "struct", "interface", "defined", "exactly", "exact", "number", "with", "from", "into", "during", "inside", "question", "ahead", "path", "replay", "write"]
# Words of a question and of a line that go together, and their points.
BONUSES = [(("lock", "rlock"), (".lock()", ".rlock()"), 5), (("next",), ("next()",), 5), (("context",), ("ctx",), 3)]


def evidence_terms(question: str, most: int = 32) -> list[str]:
    """Words of four or more characters that say what to look for, sorted."""
    words = {w.lower() for w in re.findall(r"\w{4,}", question)}
    return sorted(words - set(STOP_WORDS))[:most]


def _points(text: Column, terms: list[str], each: int, shortest: int = 1) -> Column:
    """each for every term of at least shortest characters that text holds."""
    total = F.lit(0)
    for t in terms:
        if len(t) >= shortest:
            total = total + F.when(F.contains(text, F.lit(t.lower())), each).otherwise(0)
    return total


def ranked_lines(lines: DataFrame, terms: list[str]) -> DataFrame:
    """lines with points, those without any left out: one for a term, more for what goes with it."""
    low, terms = F.lower("text"), [t.lower() for t in terms]
    points = _points(low, terms, 1)
    for words, marks, bonus in BONUSES:
        if set(words) & set(terms):
            points = points + F.when(low.rlike("|".join(map(re.escape, marks))), bonus).otherwise(0)
    points = points + F.when(F.col("text").rlike("type |func "), 2).otherwise(0)
    return lines.withColumn("points", points.cast("long")).where("points > 0")


def path_points(terms: list[str], path: str = "file") -> Column:
    low = F.lower(path)
    return _points(low, terms, 3, 3) + F.when(F.contains(low, F.lit("_test.")) | F.contains(low, F.lit("/test")), 0).otherwise(1)


def match_points(terms: list[str], query: str) -> Column:
    """Points of a matched line (file, text): its path, its terms, declarations; tests last."""
    low, path, asked = F.lower("text"), F.lower("file"), query.lower()
    declares = F.contains(low, F.lit("type "))
    points = path_points(terms) + _points(low, terms, 2, 3) + F.when(declares & F.contains(low, F.lit(" struct")), 4).otherwise(0)
    if "struct" in asked:
        points = points + F.when(declares, 6).otherwise(0)
    if "next()" in asked:
        points = points + F.when(F.contains(low, F.lit("next()")), 6).otherwise(0)
    test = path.endswith("_test.go") | F.contains(path, F.lit("/test"))
    return F.when(test, F.greatest(F.lit(0), points - 12)).otherwise(points).cast("long")


def ranked_matches(matches: DataFrame, terms: list[str], query: str) -> DataFrame:
    return matches.withColumn("points", match_points(terms, query)).orderBy(F.desc("points"), "file", "line")


def coverage(exact: list[dict], beyond: list[dict], facts: list, cards: list, slices: list) -> list[dict]:
    """Six items, each with its status and a count in words."""
    graph = any("graph:" in (h.get("reasons") or "") for h in beyond)
    rows = (
        ("exact_matches", exact, "missing", "exact lexical hits"),
        ("beyond_grep", beyond, "missing", "semantic or graph hits"),
        ("graph_neighbors", [1] if graph else [], "not_found", "kinds of graph reasons"),
        ("behavior_facts", facts, "not_found", "behaviour facts"),
        ("role_cards", cards, "not_found", "role cards"),
        ("source_snippets", slices, "missing", "slices of source"),
    )
    return [{"item": item, "status": "included" if got else none, "detail": f"{len(got)} {what}"} for item, got, none, what in rows]


def missing(query: str, exact: list, beyond: list) -> list[str]:
    out = [] if exact else [f"no symbol, line or fact matches {query!r} word for word"]
    return out if exact or beyond else [*out, "nothing related by vectors or by the graph"]
