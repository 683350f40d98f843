"""Line dedup where rows share an id or have none, by brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import line_dedup, substring_dedup
from quarry.llm._rare import rare_prefixes

A, B, C = "first line of words", "second line that nobody else has", "a third line here"
ROWS = [
    (1, "dup line"),
    (None, "dup line"),
    (None, "unique line"),
    (None, f"\n{A}"),
    (None, f"{B}\n{A}\n"),
    (7, f"{C}\n{A} of seven"),
    (7, f"x y z\n{C}"),
    (7, f"w\n{A} of seven"),
    (9, "twice the same\n\nand a line"),
    (9, "twice the same\n\nand a line"),
    (None, None),
    (None, " "),
    (None, "no id twice"),
    (None, "no id twice"),
]


def digest(t):
    return hashlib.md5((t or "").encode()).digest()


def want():
    out, earlier = Counter(), set()
    for d, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]))):
        split, left = (t or "").split("\n"), []
        for line in split:
            words = tuple(re.findall("[^\x20\x09-\x0d]+", line.lower()))
            if words and words in earlier:  # at these lengths a match of 0.8 is equality
                continue
            earlier.add(words)
            left.append(line)
        out[d, len(split), len(split) - len(left), hashlib.sha256("\n".join(left if len(left) < len(split) else split).encode()).hexdigest()] += 1
    return out


def test_rows_without_own_id(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in line_dedup.report(docs).collect()) == want()


def test_pipeline_keeps_clean_null_ids(spark):
    from corpus_pipeline import fresh_lines

    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in fresh_lines(spark, docs, "").collect()} == {(1, "dup line"), (None, "unique line")}


def test_clashing_columns(spark):
    """Columns named like those that the operators add or use inside."""
    long = " ".join(f"w{k}" for k in range(120))
    names = "tag ranges kept n_bytes n_removed n_spans n_lines _key row id digest gone copy lines".split()
    rows = [(1, long, *names), (2, f"x\n{long}", *names), (None, "other", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    left = line_dedup.dedup(docs)
    assert len(set(left.columns)) == len(left.columns) == len(docs.columns)
    assert {(r.doc_id, r.text, r.n_removed, r.tag, r.digest) for r in left.collect()} == {(1, long, 0, "tag", "digest"), (2, "x", 1, "tag", "digest"), (None, "other", 0, "tag", "digest"), (None, None, 0, "tag", "digest")}
    cut = substring_dedup.remove_repeats(docs, keep=docs.columns).collect()
    assert {(r.doc_id, r.n_removed > 0, r.row.tag, r.row.n_removed) for r in cut} == {(1, True, "tag", "n_removed"), (2, True, "tag", "n_removed"), (None, False, "tag", "n_removed")}
    from corpus_pipeline import fresh_lines, fresh_strings

    for stage in (fresh_lines, fresh_strings):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r.n_lines for r in out.collect()} == {"n_lines"}


def test_substring_rows_without_id(spark):
    """Rows without an id, or with one id, are cut by their own repeats only."""
    one, two = ("".join(chr(97 + (k * k * s) % 23) for k in range(450)) for s in (3, 7))
    texts = [(None, one), (None, two + one[:250]), (None, two[::-1]), (5, two[::-1][:100]), (5, "q" * 30 + one[100:400])]
    raw = [t.encode() for _, t in texts]
    want = []
    for k, t in enumerate(raw):
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            w = t[i : i + 200]
            if sum(o[j : j + 200] == w for o in raw for j in range(len(o) - 199)) > 1:
                gone[i : i + 200] = [True] * 200
        want.append((texts[k][0], len(t), sum(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    got = substring_dedup.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == Counter(want)


@pytest.mark.parametrize("shingle", [5, 3, 1])
@pytest.mark.parametrize("share", [25, 45])
def test_alone(spark, monkeypatch, shingle, share):
    """Never more than a class's distinct shingles that no other class has, also where words and shingles repeat in a line."""
    monkeypatch.setattr(line_dedup, "SHARE", share)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghijklmnop"[: 2 + k % 15]) for _ in range(r.randint(1, 60))) for k in range(300)]
    texts += texts[:40] + [f"  {t.upper()} \t" for t in texts[40:60]]
    lines = line_dedup._lines(spark.createDataFrame([(t,) for t in texts], "text string"), [], "text").select("c1", "line").collect()
    sets = {}
    for c1, line in lines:
        w = line.split(" ")
        sets[c1] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}
    times = Counter(t for s in sets.values() for t in s)
    got = {x.c1: x.alone for x in line_dedup._alone(spark.createDataFrame(lines), shingle).collect()}
    assert (got or shingle == 1) and all(n <= sum(times[t] == 1 for t in sets[c]) for c, n in got.items())
    assert len(sets) == 300 - sum(v > 1 for v in Counter(texts[:300]).values())


def test_lowered_bytes(spark):
    """A-Z only are lowered, and different texts stay different."""
    rows = ["AZ az \u00c0\u00e0 \u00d7\u00f7", "\u00c3\u0103\u00e3\u0123", "\u03a3\u03c3\u03c2", "\u0130i\u0131", "\u2160\u2170", "\U00010400\U00010428", "\ua640\ua641", "K\u212ak"]
    rows += [c for t in rows for c in t] + ["\tX\x0by\rz\x0c"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").repartition(2)
    got = dict(frame.select("k", line_dedup._fold(line_dedup.F.col("t"))).collect())
    plain = [re.sub("[\t\x0b\x0c\r]", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in rows]
    assert len({got[k] for k in got}) == len(set(plain)) and all((got[a] == got[b]) == (plain[a] == plain[b]) for a in got for b in got)


def test_lines_split_once(spark):
    """Spark infers no filters that split every line again before its words are made rows."""
    lines = spark.createDataFrame([(1, "a b c d e f")], "c1 long, line string")
    plan = line_dedup._alone(lines, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_prefixes_by_sort(spark):
    """Tokens counted by a sort give the prefixes that tokens counted by hash give."""
    r = random.Random(3)
    sets = spark.createDataFrame([(k, k % 7, r.sample(range(1, 60), r.randint(1, 30))) for k in range(200)], "c long, at long, tokens array<long>").repartition(4)
    both = [Counter(tuple(x) for x in rare_prefixes(sets, ["c"], ["at"], 60, 100, sort=sort).collect()) for sort in (True, False)]
    assert both[0] == both[1] and sum(both[0].values()) > 200
