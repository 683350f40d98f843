"""Query text: identifier terms, full-text expressions, intent, sub-questions."""

from __future__ import annotations

import re

RESERVED = {"and", "or", "not", "near"}


def identifier_terms(text: str) -> list[str]:
    """Lower-case pieces of at least two characters: split at what is no letter
    or digit, between lower and upper case, and before the last capital of an
    acronym; equal neighbours count once."""
    out: list[str] = []
    for word in re.findall(r"[^\W_]+", text):
        parts = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word)).split()
        parts = [p.lower() for p in parts if len(p) >= 2] or [word.lower()] * (len(word) >= 2)
        for p in parts:
            if not out or out[-1] != p:
                out.append(p)
    return out


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def full_text_terms(query: str) -> list[str]:
    """The sanitised terms of a query: phrases keep their quotes; reserved words
    and terms with punctuation get quotes; terms without a letter or digit go."""
    terms = []
    for phrase, bare in re.findall(r'"([^"]*)"?|([^\s"]+)', query):
        term = phrase or bare
        if not re.search(r"\w", term):
            continue
        plain = re.fullmatch(r"\w+", term) and term.lower() not in RESERVED and not phrase
        terms.append(term if plain else f'"{term.strip()}"')
    return terms


def sanitise(query: str) -> str:
    return " ".join(full_text_terms(query))


def full_text_match(query: str) -> str:
    return "exact_phrase" if any(t.startswith('"') and re.search(r"\s", t) for t in full_text_terms(query)) else "token_match"


def query_intent(query: str) -> tuple[str, float, list[str]]:
    q = query.strip()
    intent, confidence, why = "conceptual", 0.55, []
    rules = (
        ("/" in q or "\\" in q, "path", 0.85, "contains a path separator"),
        ("::" in q or "." in q or "_" in q, "symbol", 0.82, "contains identifier punctuation"),
        (re.fullmatch(r"[A-Z0-9_]+", q) and re.search("[A-Z]", q), "operational_fact", 0.9, "looks like a constant"),
        (" " not in q and any(c.isupper() for c in q), "symbol", 0.78, "looks like a mixed-case identifier"),
    )
    for holds, name, sure, reason in rules:
        if holds:
            intent, confidence = name, sure if name == "operational_fact" else max(confidence, sure)
            why.append(reason)
    if not why and len(identifier_terms(q)) >= 4:
        return "conceptual", 0.7, ["several words of natural language"]
    return intent, confidence, why or ["default reading"]


def line_pattern(query: str) -> str:
    """A case-insensitive expression that finds the query's terms in order in a line."""
    terms = identifier_terms(query)
    return ".*".join(map(re.escape, terms)) if len(terms) >= 2 else re.escape(query.strip())


def string_literals(line: str) -> list[str]:
    """Contents of the quoted strings of one line; escapes stay as written."""
    return [next(g for g in m if g is not None) for m in re.findall(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|`((?:[^`\\]|\\.)*)`', line) for m in [tuple(x or None for x in m)] if any(m)]


def sub_questions(query: str) -> list[tuple[str, str]]:
    """(label, text): headed parts, else numbered ones, else lettered or listed ones, else the whole."""
    for pattern in (r"(?m)^\s*#{1,6}\s*(Q?\d+)[.:)]?\s*", r"(?m)(?:^|(?<=\s))(Q\d+)[.:)]\s*", r"(?m)^\s*((?:[a-z]|\d{1,2}))[.)]\s+"):
        marks = list(re.finditer(pattern, query))
        if len(marks) > 1:
            head = query[: marks[0].start()].strip()
            ends = [*(m.start() for m in marks[1:]), len(query)]
            return [(m[1], f"{head} {query[m.end():e].strip()}".strip()) for m, e in zip(marks, ends)]
    return [("Q1", query.strip())]


def key_names(text: str, most: int = 24) -> list[str]:
    """Quoted code and words that look like identifiers, sorted."""
    found = set(re.findall(r"`([^`]+)`", text))
    for word in re.findall(r"[A-Za-z_][\w.:]*", text):
        word = word.strip(".:")
        if len(word) > 2 and (re.search(r"[._:]|\d", word) or re.search(r"[a-z][A-Z]", word)):
            found.add(word)
    return sorted(found)[:most]


def repo_paths(text: str) -> list[str]:
    """Relative paths of source or configuration files that a text names."""
    paths = re.findall(r"(?<![\w/.])((?:[\w.-]+/)+[\w.-]+\.(?:tsx?|jsx?|go|java|rs|cs|json|toml|ya?ml|md))\b", text)
    return sorted({p for p in paths if ".." not in p.split("/")})


def line_ranges(text: str, before: int = 4, after: int = 8, most: int = 80) -> list[tuple[int, int]]:
    """Requested line ranges: a-b as it is, a single line with its surroundings."""
    out = []
    for a, b in re.findall(r"\blines?\s+(\d+)(?:\s*[-–]\s*(\d+))?", text, re.I):
        lo, hi = (int(a), int(b)) if b else (max(1, int(a) - before), int(a) + after)
        if lo <= hi:
            out.append((lo, min(hi, lo + most - 1)))
    return out
