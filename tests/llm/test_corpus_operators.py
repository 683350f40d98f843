"""Operators that compare documents, lines or calls, against brute force; the pipeline."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from quarry.llm import _graph, line_dedup, near_dup, packing, queries, sql, substring_dedup, tool_calls  # noqa: E402

R = np.random.default_rng(11)
WORDS = ["".join(R.choice(list("aeinorstlmd"), int(R.integers(2, 8)))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS, n))


def edited(text, share):
    return " ".join(w if R.random() > share else str(R.choice(WORDS)) for w in text.split(" "))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


def shingles(w, k):
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


@pytest.fixture(scope="module")
def rows():
    base = prose(150)
    group = [edited(base, s) for s in R.uniform(0, 0.12, 70)]  # links only through others among them
    lines = "\n".join(prose(int(n)) for n in R.integers(1, 40, 8))
    texts = [None, "", "  ", "one", "One", "one two", "ONE two", lines, lines + "\n" + prose(30), *group, base, base.upper(), prose(12) + " " + base, "tail " * 900, "tail " * 901, "ab" * 400]
    texts += [prose(60) + "\n" + edited(base, 0.02) + "\n" + prose(20) for _ in range(12)] + [prose(int(n)) for n in R.integers(1, 200, 30)]
    return [(3 * i, t) for i, t in enumerate(texts)] + [(21, texts[7]), (None, "no id here"), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int").repartition(4)


@pytest.mark.parametrize(("shingle", "width"), [(2, 8), (5, 2)])
def test_near_groups(docs, rows, shingle, width, monkeypatch):
    monkeypatch.setattr(near_dup, "WIDTH", width)  # 2: stars of several rounds
    known = [r for r in rows if r[0] is not None]
    sets = [(d, shingles(words(t), shingle)) for d, t in known]
    up = {d: d for d, _ in known}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = near_dup.near_groups(docs, shingle=shingle).collect()
    assert len(got) == len(rows)
    size = defaultdict(set)
    for d, s in sets:
        size[d].add(len(s))
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id) and r.n_shingles in size[r.doc_id]
    assert near_dup.near_groups(docs.limit(0)).count() == 0


def test_signatures_estimate_jaccard():
    a = np.unique(R.integers(0, 1 << 63, 40).astype(np.uint64))
    for share in (0.5, 0.8):
        k = int(len(a) * share)
        b = np.unique(np.concatenate([a[:k], R.integers(0, 1 << 63, len(a) - k).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = near_dup.densified([a, b], 4096)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert (near_dup.densified([a[:1]], 64) == a[0]).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(_graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}
    more = _graph.joined_components(spark.createDataFrame(list(got.items()), "node long, component long"), spark.createDataFrame([(60, 150), (900, 901)], "a long, b long"))
    assert dict(more.collect()) == {**{k: 0 for k in [*range(61), 100, 150, 200]}, 900: 900, 901: 900}


@pytest.mark.parametrize("width", [8, 2])
def test_line_dedup(docs, rows, width, monkeypatch):
    monkeypatch.setattr(line_dedup, "WIDTH", width)
    places = sorted({(1 << 63 if d is None else d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n"))})
    gone, earlier = set(), []
    for d, i, line in places:
        s = shingles(words(line), 5)
        if s and any(100 * len(s & o) >= 80 * len(s | o) for o in earlier):
            gone.add((d, i))
        earlier.append(s)
    got = line_dedup.report(docs).collect()
    assert len(got) == len(rows)
    want = defaultdict(set)
    for d, t in rows:
        if d is not None and d != 21:
            split = (t or "").split("\n")
            left = [x for i, x in enumerate(split) if (d, i) not in gone]
            want[d].add((len(split), len(split) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    for r in got:
        if r.doc_id in want:
            assert (r.n_lines, r.n_removed, r.kept_sha256) in want[r.doc_id], r.doc_id
    assert line_dedup.report(docs.limit(0)).count() == 0


def repeats(texts, length):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    for t in texts:
        m = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        yield m


def test_substring_dedup(docs, rows):
    raw = [(t or "").encode() for _, t in rows]
    want = defaultdict(list)
    for (d, _), t, m in zip(rows, raw, repeats(raw, 200)):
        n = int((m[1:] & ~m[:-1]).sum() + (m[0] if len(t) else 0))
        kept = bytes(b for b, gone in zip(t, m) if not gone)
        want[d].append((len(t), int(m.sum()), n, hashlib.sha256(kept).hexdigest()))
    got = defaultdict(list)
    for r in substring_dedup.report(docs).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert substring_dedup.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_run_length_index(alphabet):
    base = bytes(R.choice(list(alphabet), 500).astype(np.uint8))
    for _ in range(8):
        texts = [base[(a := int(R.integers(0, 400))) : a + int(R.integers(1, 300))] + bytes(R.choice(list(alphabet), 30).astype(np.uint8)) for _ in range(6)]
        index = substring_dedup.RunLengthIndex(texts)
        suffixes = [next(t[p - at :] for t, at in reversed([*zip(texts, index.at.tolist())]) if p >= at) for p in index.order.tolist()]
        key = [s + b"\xff" for s in suffixes]
        assert key == sorted(key)
        assert len(index.runs) < len(index.order) and len(index.sampled) == len(index.heads)
        common = index.common()
        for a, b, p in zip(suffixes, suffixes[1:], index.order[1:].tolist()):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common[p] == n
        for length in (20, 120):
            for m, found in zip(repeats(texts, length), substring_dedup.repeated(texts, np.arange(6) * 10_000, length)):
                mine = np.zeros(len(m), bool)
                for a, b in found:
                    mine[a:b] = True
                assert (mine == m).all()


def test_spans_meet():
    """Equal windows lie in spans of equal anchors, at equal places."""
    text = prose(600).encode()
    doc, lo, size, anchor, _ = substring_dedup.spans([text, b"zzz " + text[500:2500]])
    first, second = set(anchor[doc == 0].tolist()), set(anchor[doc == 1].tolist())
    assert len(first & second) > 0.8 * len(second)
    covered = sum(s - substring_dedup.LENGTH + 1 for d, s in zip(doc, size) if d == 0)
    assert covered == len(text) - substring_dedup.LENGTH + 1


def test_tool_calls(spark):
    call = "conv_id long, call_id string, after string, name string, arguments string"
    schema = {"find": {"q": ("string", True, 1, 5), "n": ("integer", False, 1, 9), "o": ("object", False, None, None)}}
    calls = [
        (1, "a", None, "find", '{ "q": "x", "o": {"z": 1, "b": [2, {"d":1,"c":2}]} }'),
        (1, "b", "a", "find", '{"q": "toolong", "n": 0}'),
        (1, "c", "b", "find", '{"n": "7", "k": 1}'),
        (1, "d", "absent", "none", "{}"),
        (1, "e", "f", "find", "not json"),
        (1, "f", "e", "find", "[1]"),
        (1, "b", "a", "find", '{"q": "zz"}'),
        (None, "a", None, "find", "{}"),
        (2, "a", None, "find", None),
    ] + [(3, f"k{k}", f"k{k - 1}" if k else None, "find", '{"q":"x"}') for k in range(40)]
    results = [(1, "a", "ré\n"), (1, "a", "later"), (1, "zz", "lost"), (2, None, "none")]
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(spark.createDataFrame(calls, call), spark.createDataFrame(results, "conv_id long, call_id string, content string"), schema).collect()}
    assert got[(1, "a")].canonical == '{"arguments":{"o":{"b":[2,{"c":2,"d":1}],"z":1},"q":"x"},"id":"a","level":0,"name":"find","result":"later","status":"linked","valid":true}'
    assert (got[(1, "b")].level, got[(1, "b")].n_calls, got[(1, "b")].errors) == (1, 2, "n: below 1; q: above 5")
    assert got[(1, "c")].errors == "k: not in the schema; n: not of type integer; q: missing" and got[(1, "c")].level == 2
    assert (got[(1, "d")].errors, got[(1, "d")].level) == ("unknown tool", 0)
    assert got[(1, "e")].errors == got[(1, "f")].errors == "arguments are no object" and got[(1, "e")].level is None
    assert got[(1, "zz")].status == "orphan" and got[(2, "a")].n_errors == 1
    assert [got[(3, f"k{k}")].level for k in range(40)] == list(range(40))
    assert all(json.loads(r.canonical) for r in got.values())
    none = spark.createDataFrame([], call)
    assert tool_calls.link(none, none.select("conv_id", "call_id", F.lit("").alias("content")), schema).count() == 0


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(sql.SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in queries.QUERIES


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    left = [r.text.encode() for r in docs.collect()]
    tokens = lambda d: sorted(map(tuple, d.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    want = tokens(packing.pack(docs, queries.vocabulary("word_bpe_49k.json")))
    assert tokens(corpus_pipeline.STAGES[-1][1](spark, docs, sf)) == want
    assert all(b"\xef\xbf\xbd" not in t for t in left)
    assert tokens(corpus_pipeline.run(spark, sf)) == want
