"""Inspection of handles, and bundled evidence for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import text
from quarry.operators import lines as source_lines
from quarry.operators import search

_KINDS = ("symbol", "fact", "callsite", "file")


def parse_handle(handle: str) -> tuple[str, str, str | None]:
    """(kind, id or path, revision). symbol:12@idx-…, file:<hex of the path>."""
    kind, _, rest = handle.partition(":")
    body, _, revision = rest.partition("@")
    if kind not in _KINDS or not body:
        raise ValueError(f"no handle: {handle!r}")
    if kind == "file":
        try:
            body = bytes.fromhex(body).decode()
        except ValueError as e:
            raise ValueError(f"no file handle: {handle!r}") from e
        if body.startswith("/") or ".." in body.split("/"):
            raise ValueError(f"{body} leaves the tree")
    elif not body.isdigit():
        raise ValueError(f"no id in {handle!r}")
    return kind, body, revision or None


def inspect(handle: str, tables: dict[str, DataFrame], *, offset: int = 0, max_lines: int = schemas.INSPECT_LINES, max_chars: int = schemas.INSPECT_CHARS, revision: str | None = None) -> dict:
    """A bounded slice of the source a handle names. tables: lines, and symbols, facts
    or callsites. A handle of another revision is read all the same and marked."""
    kind, body, wanted = parse_handle(handle)
    count, chars = max(1, min(max_lines, schemas.INSPECT_LINES)), max(1, min(max_chars, schemas.INSPECT_CHARS))
    if kind == "file":
        file, first, last = body, 1, None
    else:
        row = tables[f"{kind}s"].where(F.col("id") == int(body)).select("file", "line", "end_line").first()
        if row is None:
            raise ValueError(f"unknown handle {handle!r}")
        file, first, last = row
    start = first + offset
    stop = start + count - 1 if last is None else min(last, start + count - 1)
    span = tables["lines"].sparkSession.createDataFrame([(file, start, stop)], "file string, first long, last long")
    cut = source_lines.snippet(tables["lines"].where(F.col("file") == file), span, chars).first()
    end = cut.end_line if cut else start - 1
    more = tables["lines"].where((F.col("file") == file) & (F.col("line") > end) & (F.lit(True) if last is None else F.col("line") <= last)).limit(1).count() > 0
    out = {"handle": handle, "file": file, "start_line": start, "end_line": end, "text": cut.text if cut else "", "truncated": bool(cut and cut.truncated), "next_offset": end - first + 1 if more else None}
    if wanted and revision and wanted != revision:
        out["warning"] = "handle of another revision"
    return out


def card_view(cards: DataFrame, files: list[str], most: int = 2, items: int = schemas.CARD_ITEMS) -> list[dict]:
    """The first cards of these files by name, their lists cut."""
    lists = [c for c, t in cards.dtypes if t.startswith("array")]
    rows = cards.where(F.col("file").isin(files)).orderBy("file").limit(most)
    return [r.asDict() for r in rows.select(*(F.slice(c, 1, items).alias(c) if c in lists else F.col(c) for c in cards.columns)).collect()]


def pack(question: str, symbols: DataFrame, graph: DataFrame, lines: DataFrame, cards: DataFrame | None = None, *, tokens: int = 8_000, **vector_options) -> dict:
    """Evidence for a question of one or several parts: hits, slices, cards, coverage."""
    tokens = max(1, min(tokens, schemas.EVIDENCE_TOKENS))
    limit = max(2, min(tokens // 180, schemas.EVIDENCE_RESULTS))
    parts, named = text.sub_questions(question), text.key_names(question)
    paths = text.repo_paths(question)
    answers, handles = [], []
    for label, part in parts:
        hints = [n for n in named if n in part] or text.key_names(part)
        found = search.search(symbols, graph, " ".join([part, *hints[:6]]) if not hints else hints[0], limit, **vector_options)
        if paths:
            found = found.where(F.col("file").isin(paths))
        hits = [r.asDict() for r in found.collect()]  # at most limit rows
        exact = [h for h in hits if h["bucket"] == "exact"]
        hits = exact or hits
        answers.append({"question": label, "text": part, "intent": text.query_intent(part)[0], "hits": hits, "missing": [] if hits else hints})
        handles += [f"symbol:{h['id']}" for h in hits[: 4 if len(parts) > 1 else 8]]
    handles = sorted(set(handles))
    room = max(800, min(tokens * schemas.CHARS_PER_TOKEN // max(1, len(handles)), 6_000))
    tables = {"symbols": symbols, "lines": lines}
    slices = [inspect(h, tables, max_chars=room) for h in handles]
    files = sorted({h["file"] for a in answers for h in a["hits"][:3]})
    return {
        "contract": {"name": "evidence_pack", "version": 1},
        "answers": answers,
        "slices": [s for s in slices if s["text"]],
        "cards": card_view(cards, files) if cards is not None else [],
        "coverage": {"asked": len(parts), "answered": sum(bool(a["hits"]) for a in answers), "paths": paths, "ranges": text.line_ranges(question)},
    }


def batch(queries: list, symbols: DataFrame, graph: DataFrame, limit: int = 8) -> list[dict]:
    """Up to 32 searches; entries are strings or dicts with query, limit and kind."""
    if not 1 <= len(queries) <= 32:
        raise ValueError("1 to 32 queries")
    out = []
    for q in queries:
        q = {"query": q} if isinstance(q, str) else q
        if not q.get("query", "").strip():
            raise ValueError("an empty query")
        hits = [r.asDict() for r in search.search(symbols, graph, q["query"], q.get("limit", limit), kind=q.get("kind")).collect()]
        out.append(search.envelope(q["query"], hits, tokens=900))
    return out
