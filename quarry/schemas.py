"""Table schemas, value domains and limits of the retrieval engine."""

from __future__ import annotations

SCHEMAS = {
    "symbols": "id long, name string, kind string, file string, line long, end_line long, language string, context string",
    "edges": "id long, source_id long, target_id long, target_name string, target_file string, relationship string, confidence double, original_name string",
    "facts": "id long, fact_type string, value string, file string, line long, end_line long, enclosing string, occurrence_count long",
    "callsites": "id long, file string, line long, end_line long, callee string, receiver string, target string, resolved_id long, arguments array<string>, aliases array<string>, enclosing string, confidence double, generic boolean, downweighted boolean",
    "aliases": "id long, file string, line long, end_line long, local_name string, imported_name string, source string, alias_kind string, enclosing string",
    "role_cards": "file string, content_hash string, responsibility string, exported array<string>, imported array<string>, facts array<string>, tests array<string>, related array<string>, centrality double",
    "cochange": "file_a string, file_b string, frequency long, recency double",
    "embeddings": "symbol_id long, embedding array<float>",
    "index_meta": "file string, content_hash string, fingerprint string, last_indexed timestamp",
}
SCHEMA_VERSION = 5

# Limits and weights.
RRF = 60
SQL_LIMIT = 1000
SEARCH_LIMIT, BEYOND_LIMIT, SYMBOL_LIMIT, EXPANSION_LIMIT, STRUCTURAL_CAP = 100, 3, 256, 12, 30
INSPECT_LINES, INSPECT_CHARS, SUMMARY_CHARS, SNIPPET_CHARS = 32, 32_000, 160, 240
EVIDENCE_TOKENS, EVIDENCE_RESULTS, CARD_ITEMS, SEARCH_TOKENS, CHARS_PER_TOKEN = 16_000, 24, 5, 2_000, 4
WEIGHTS = {"structural": 0.45, "semantic": 0.35, "evolutionary": 0.20}
COUPLING_THRESHOLD, MAX_FREQUENCY = 0.30, 10
MAX_COMMITS, MAX_FILES_PER_COMMIT, DEBOUNCE_MS, MAX_FILE_BYTES, DIMENSIONS, BATCH = 500, 20, 500, 512_000, 768, 32
# Weights of relationships; any other one weighs 0.5.
RELATIONSHIPS = {"calls": 1.0, "extends": 1.0, "called_by": 0.9, "extended_by": 0.9, "instantiates": 0.85, "imports": 0.5, "imported_by": 0.4, "co_located": 0.2}
# Names that are too general to follow.
GENERIC_TARGETS = ["map", "filter", "reduce", "forEach", "find", "some", "every", "then", "catch", "finally", "call", "apply", "bind", "log", "warn", "error", "info", "debug", "require"]


def checked_limit(limit: int) -> int:
    """A row limit; more than SQL_LIMIT is an error, not a clamp."""
    if limit > SQL_LIMIT or limit < 0:
        raise ValueError(f"limit {limit} is not within 0..{SQL_LIMIT}")
    return limit
