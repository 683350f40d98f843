"""Fused search: channels of candidates, additive scores, graph expansion, buckets, budget."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import scoring
from quarry.functions.text import identifier_terms, query_intent
from quarry.operators import fts, graph as g, lines as source_lines, lookup, vector

CHANNEL = ["id", "channel", "signal", "lexical", "reason"]


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds rank from 0; rows are at most a channel's limit, so one task is enough."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def target_match(query: str, name: str = "name"):
    """exact, method_suffix or contains, against the query's words and itself."""
    import re

    words = {w.lower() for w in re.findall(r"\w{2,}", query)}
    if re.fullmatch(r"[\w.:#]+", query.strip()):
        words.add(query.strip().lower())
    low = F.lower(name)
    suffix = "|".join(re.escape(w) for w in sorted(words)) or "(?!)"
    return F.when(low.isin(*words), "exact").when(low.rlike(f"[.:#](?:{suffix})$"), "method_suffix").otherwise("contains")


def channels(symbols: DataFrame, query: str, limit: int, *, vectors: DataFrame | None = None, embedded: list[float] | None = None, semantic_weight: float = 0.15) -> DataFrame:
    """CHANNEL rows of the symbol, ordered-term, full-text and vector channels."""
    boost = scoring.kind_boost("kind")
    found = _ranked(lookup.list_symbols(symbols, query, limit), "match", "file", "line", "name", "id")
    weight = scoring.match_weight(target_match(query))
    out = found.select("id", F.lit("symbol").alias("channel"), ((1.0 + scoring.rrf("rank")) * boost * weight).alias("signal"), F.lit(True).alias("lexical"), F.concat(F.lit("symbol:"), "kind").alias("reason"))
    if len(identifier_terms(query)) >= 2:
        tokens = _ranked(lookup.ordered_terms(symbols, query, limit), F.desc("in_name"), "file", "line", "name", "id")
        out = out.union(tokens.select("id", F.lit("tokens"), (0.8 + scoring.rrf("rank")) * boost * weight, F.lit(True), F.lit("symbol:ordered_tokens")))
    text = _ranked(fts.bm25(symbols, "id", ["name", "kind", "file", "context"], query, limit), "score", "id")
    kinds = symbols.select("id", "kind")
    out = out.union(text.join(kinds, "id").select("id", F.lit("fts"), scoring.rrf("rank") * boost, F.lit(True), F.concat(F.lit("exact:"), "field")))
    if vectors is not None and embedded is not None:
        near = _ranked(vector.knn(vectors, embedded, limit, id_col="id"), "distance", "id")
        out = out.union(near.join(kinds, "id").select("id", F.lit("vector"), scoring.rrf("rank") * boost * semantic_weight, F.lit(False), F.lit("semantic")))
    return out


def wants_lines(query: str, found: int, limit: int) -> bool:
    """Whether files are scanned: few other hits, or a query that looks like code or a phrase."""
    q, terms = query.strip(), identifier_terms(query)
    if limit <= 0 or len(q) < 3 or not terms:
        return False
    return found < limit or any(c in ":_./\\()-" for c in q) or (len(terms) >= 3 and len(q) >= 12)


def line_limit(query: str, limit: int) -> int:
    return max(32, min(512, limit * (16 if len(identifier_terms(query)) >= 3 else 8)))


def line_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """hits (file, line and more) with id, name, kind: the symbol around the line; of a file
    without symbols a row of kind file_match with an id below 0; lines between symbols go."""
    inner = lookup.enclosing(hits.select("file", "line"), symbols).withColumnsRenamed({"symbol_id": "id", "symbol_name": "name"})
    inner = inner.join(symbols.select("id", "kind"), "id")
    bare = hits.select("file", "line").distinct().join(symbols.select("file").distinct(), "file", "left_anti")
    bare = bare.select("file", "line", (-1 - F.shiftrightunsigned(F.xxhash64("file", "line"), 1)).alias("id"), F.element_at(F.split("file", "/"), -1).alias("name"), F.lit("file_match").alias("kind"))
    return hits.join(inner.select("file", "line", "id", "name", "kind").unionByName(bare), ["file", "line"])


def line_channel(lines: DataFrame, symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """CHANNEL rows (one per matching line) with the columns of symbols that a hit shows."""
    hits = _ranked(source_lines.ranked_scan(lines, query, line_limit(query, limit)), F.desc("points"), "file", "line")
    met = line_symbols(hits, symbols)
    weight = scoring.line_weight(F.col("match"), scoring.match_weight(target_match(query)))
    return met.select("id", F.lit("line").alias("channel"), ((0.7 + scoring.rrf("rank")) * scoring.kind_boost("kind") * weight).alias("signal"), F.lit(True).alias("lexical"), F.lit("exact:file_line").alias("reason"), "name", "kind", "file", "line")


def fact_search(facts: DataFrame, query: str, limit: int) -> DataFrame:
    """The facts that hold the query's words (in type, value or file), the best first, with score and field."""
    hits = fts.bm25(facts, "id", ["fact_type", "value", "file"], query)
    return facts.join(hits, "id").orderBy("score", "file", "line", "fact_type", "value", "id").limit(limit)


def fact_channel(facts: DataFrame, symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """CHANNEL rows of facts within a symbol (symbol_id); facts without one count in the ranks."""
    ranked = _ranked(fact_search(facts, query, limit), "score", "file", "line", "fact_type", "value", "id")
    met = ranked.select(F.col("symbol_id").alias("id"), "fact_type", "rank").join(symbols.select("id", "kind"), "id")
    return met.select("id", F.lit("fact").alias("channel"), (scoring.rrf("rank") * scoring.kind_boost("kind")).alias("signal"), F.lit(True).alias("lexical"), F.concat(F.lit("fact:"), "fact_type").alias("reason"))


def receiver_types(hits: DataFrame, symbols: DataFrame, score: float = 2.5) -> DataFrame:
    """For methods among hits (kind, name, file) the class or interface of the same file that
    the part before the last dot names, one for each: id, name, kind, file, line, score."""
    owner = F.regexp_extract("name", "^(.*)\\.[^.]+$", 1)
    asked = hits.where("kind = 'method'").select("file", owner.alias("owner")).where("owner <> ''").distinct()
    types = symbols.where("kind in ('class', 'interface')").select("file", F.col("name").alias("owner"), F.struct("line", "id", "name", "kind").alias("s"))
    best = asked.join(types, ["file", "owner"]).groupBy("file", "owner").agg(F.min("s").alias("s"))
    return best.select("s.id", "s.name", "s.kind", "file", "s.line", F.lit(score).alias("score"))


def fused(symbols: DataFrame, graph: DataFrame, found: DataFrame) -> DataFrame:
    """id, score, exact, reasons: signals summed per symbol; every lexical row (repeats
    too) adds the structural score of each neighbour; scores normalised by the best."""
    seeds = found.where("lexical").select(F.col("id").alias("node"))
    near = g.neighbours(graph, seeds).join(symbols.select("id", "name"), "id").where(~scoring.generic_target("name"))
    spread = seeds.join(near, "node").select("id", F.lit("graph"), scoring.structural("relationship", "confidence", F.lit(1)), F.lit(False), F.concat(F.lit("graph:"), "relationship"))
    rows = found.select(*CHANNEL).union(spread).groupBy("id").agg(F.sum("signal").alias("raw"), F.max("lexical").alias("exact"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    best = rows.agg(F.max("raw").alias("best"))
    return rows.join(F.broadcast(best)).select("id", scoring.normalised("raw", F.col("best")).alias("score"), "exact", "reasons")  # one row


def buckets(rows: DataFrame, symbols: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """exact hits up to limit, others up to three of what is left; bucket, rank (from 1)."""
    hits = rows.join(symbols.select("id", "name", "kind", "file", "line"), "id")
    if kind:
        hits = hits.where(F.col("kind").isin("function", "method") if kind in ("function", "method") else F.col("kind") == kind)
    order = [F.desc("score"), "file", "line", "name", "id"]
    exact = hits.where("exact").orderBy(*order).limit(limit)
    exact = exact.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("bucket", F.lit("exact"))
    taken = exact.agg(F.count("*").alias("taken"))
    other = hits.where("not exact").orderBy(*order).limit(min(limit, schemas.BEYOND_LIMIT))
    other = other.withColumn("rank", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(taken)).where(F.col("rank") <= limit - F.col("taken")).drop("taken")
    return exact.unionByName(other.withColumn("bucket", F.lit("beyond")))


def search(symbols: DataFrame, graph: DataFrame, query: str, limit: int = schemas.SEARCH_LIMIT, *, kind: str | None = None, facts: DataFrame | None = None, lines: DataFrame | None = None, **vector_options) -> DataFrame:
    """Hits of all channels; facts (with symbol_id) and lines are searched where they are given."""
    limit = min(limit, schemas.SEARCH_LIMIT)
    most = limit * (10 if kind else 3)
    shown = symbols.select("id", "name", "kind", "file", "line")
    found = channels(symbols, query, most, **vector_options)
    if facts is not None:
        found = found.unionByName(fact_channel(facts, symbols, query, most))
    if lines is not None and (wants_lines(query, most, most) or wants_lines(query, found.where("lexical").limit(most).count(), most)):
        at = line_channel(lines, symbols, query, most)
        found = found.unionByName(at.select(*CHANNEL))
        shown = shown.unionByName(at.where("id < 0").select("id", "name", "kind", "file", "line").distinct())
    return buckets(fused(symbols, graph, found), shown, limit, kind)


def graph_mode(symbols: DataFrame, graph: DataFrame, target: int, mode: str, limit: int) -> DataFrame:
    """callers and implementations walk to dependents, callees and impact to dependencies; three steps."""
    one = graph.sparkSession.createDataFrame([(target,)], "source long")
    rows = g.bfs(graph, one, 3, reverse=mode in ("callers", "implementations", "implementors"))
    if mode.startswith("implement"):
        rows = rows.where("relationship = 'implements'")
    rows = rows.join(symbols.select("id", "name", "file", "line"), "id").where(~scoring.generic_target("name"))
    return rows.select("id", "name", "file", "line", "depth", scoring.structural("relationship", "confidence", "depth").alias("score")).orderBy(F.desc("score"), "file", "line", "name", "id").limit(limit)


def envelope(query: str, hits: list[dict], tokens: int = schemas.SEARCH_TOKENS) -> dict:
    """The answer as a dict that stays within the budget: hits go from the end, those
    beyond exact matches first."""
    intent, sure, why = query_intent(query)
    hits = sorted(hits, key=lambda h: (h["bucket"] != "exact", h["rank"]))
    total = len(hits)
    while True:
        out = {"contract": {"name": "search", "version": 1}, "intent": {"intent": intent, "confidence": sure, "reasons": why}, "exact_hits": [h for h in hits if h["bucket"] == "exact"], "beyond_grep": [h for h in hits if h["bucket"] != "exact"], "truncated": len(hits) < total}
        size = len(json.dumps(out, ensure_ascii=False))
        if size <= tokens * schemas.CHARS_PER_TOKEN or not hits:
            return out | {"returned_tokens": -(-size // schemas.CHARS_PER_TOKEN)}
        hits.pop()
