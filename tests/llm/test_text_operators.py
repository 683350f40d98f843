"""Operators that work on one text at a time, against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import sentencepiece

public = pytest.importorskip("public_tokenizers")

from quarry.llm import exact_dedup, license_scan, packing, quality_mil, sp_codec, ts_media  # noqa: E402

TEXTS = [None, "", " ", "a  b\t\nc", "Été Σας don't 12 ½² <|endoftext|> x", "日本語 🎉 ▁x▁▁y\x00", "word " * 3000, "\n\n x", "mit license MIT License", "a" * 700, "a  b\t\nc"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 7), (None, "lone text", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, run int").repartition(3)


def empty(docs):
    return docs.limit(0)


# -- packing ----------------------------------------------------------------------
def test_packing(docs):
    path = public.path("word_bpe_49k.json")
    tok = packing.WordTokenizer(path).tokenizer
    pieces = [r.asDict() for r in packing.pack(docs, path, with_ids=True).collect()]
    seqs: dict = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for parts in seqs.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert sum(p["length"] for p in parts) <= 2048
    for i, t in enumerate(TEXTS):
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        want = array("I", [*tok.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()
        if i == 3:  # the row is there twice
            assert sum(p["length"] for p in mine) * 4 == 2 * len(want)
            continue
        assert b"".join(p["ids"] for p in mine) == want and {p["doc_tokens"] for p in mine} == {len(want) // 4}
    assert packing.pack(empty(docs), path).count() == 0
    assert packing.padding(packing.pack(docs, path)).first()["padding"] == 0


def test_packing_pads_little():
    r = np.random.default_rng(0)
    docs = [(i, b"\1\0\0\0" * int(n)) for i, n in enumerate(r.integers(1, 3000, 4000))]
    rows, _ = packing.Packer().pack(docs, 0)
    assert sum(x[2] for x in rows) == sum(len(d) // 4 for _, d in docs)
    fill = Counter()
    for x in rows:
        fill[x[5]] += x[2]
    padded = sum(2048 - n for n in fill.values() if n & (n - 1))
    assert max(fill.values()) <= 2048 and padded < 0.01 * sum(fill.values())
    assert len(rows) < 1.5 * len(docs) + len(fill)


def test_nnls():
    rows = packing.combinations(8)
    assert all(sum(x) == 8 for x in rows.tolist())
    x = np.zeros(len(rows))
    x[[1, 3, 6]] = [5, 2, 7]
    a = np.array([[list(r).count(b) for r in rows.tolist()] for b in range(1, 9)], float)
    got = packing.nnls(rows, a @ x, 50)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


# -- pieces -----------------------------------------------------------------------
def test_codec(docs):
    path = public.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {}
    for r in sp_codec.encode(docs, path).collect():
        got.setdefault(r.doc_id, []).append(r)
    dig = {r.doc_id: r for r in sp_codec.digests(docs, path).collect()}
    assert len(got[3]) == 2
    for i, t in enumerate(TEXTS):
        r, want = got[i][0], lib.encode(t or "") + [2]
        assert r.ids == want and r.decoded == lib.decode(want)
        raw = (t or "").encode()
        assert len(r.span_start) == len(want) - 1 and "".join(raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(r.span_start, r.span_end)) == raw.decode("utf-8", "surrogateescape")
        assert dig[i].n_tokens == len(want) and dig[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert sp_codec.digests(empty(docs), path).count() == 0


def test_merge_is_the_librarys():
    path = public.path("piece_bpe_32k.model")
    codec, lib = sp_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    words = ["hello", "Ünïcödé", "日本", "aaaaaaaaaaaa", "x🎉y", "1234,56", "internationalisation" * 9, "ab" * 200, "\x00"]
    for w in words:
        assert codec.merge("▁" + w) == lib.encode(w)
    ids, counts = codec._merged_short(["▁" + w for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [lib.encode(w) for w in words]


def test_character_map():
    """A hand-made double array with the keys 'ab' -> 'X' and 'a' -> 'yy', against a scan of the longest key."""
    pool = b"X\0yy\0"
    units = [0] * 1024
    # the root's base is 256; a node's children are at its place xor offset xor label
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | 512 << 10  # has a leaf
    base = a ^ 512
    units[base] = 2 | 1 << 31  # 'a' -> pool[2:]
    b = base ^ ord("b")
    units[b] = ord("b") | 1 << 8 | 512 << 10
    units[b ^ 512] = 0 | 1 << 31  # 'ab' -> pool[0:]
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + pool
    for blob, text, want, at in ((blob, "abac é", "Xyyc é", [0, 2, 2, 3, 4, 5, 6, 7]), (b"", "ab", "ab", [0, 1, 2])):
        new, source = sp_codec.CharMap(blob).apply(text.encode())
        assert new == want.encode() and source.tolist() == at


@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_map(tmp_path, squeeze):
    """The pieces of the model behind the compiled map of a built-in normaliser, against the library: ids, decoded text, spans."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    codec, lib = sp_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert codec.map.units
    texts = ["", "Hello  World", " ＡＢＣ １２３ ﬁne", "Ｔｈｅ ½ ㌔ Straße", "e\u0301tude ÀÉ", "a\tb\nc  ", "日本語　テスト", "x🎉Y " * 50, "▁ a"]
    for text, got in zip(texts, codec.encode_batch(texts)):
        want = lib.encode(text, out_type="proto")
        assert got[0].tolist() == [p.id for p in want.pieces], text
        assert got[4] == lib.decode([p.id for p in want.pieces])
        assert got[2].tolist() == [p.end for p in want.pieces], text


# -- transport streams ------------------------------------------------------------
@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 70_016])
def test_stream_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    raw = ts_media.write(payload)
    got = ts_media.read(raw)
    assert got.payload == payload and got.errors == got.continuity_errors == 0 and len(raw) % 188 == 0
    assert len(got.times) == -(-n // ts_media.UNIT) and got.times == sorted(got.times)
    assert got.access[0] == (ts_media.FIRST_TICK, 376) and len(got.access) == -(-len(got.times) // ts_media.RANDOM_ACCESS)
    from_there = ts_media.read(raw[:376] + raw[got.access[-1][1] :])
    assert from_there.times[0] == got.access[-1][0]


def test_broken_streams():
    raw = ts_media.write(bytes(9000))
    lost = ts_media.read(raw[: 188 * 9] + raw[188 * 10 :])
    assert lost.continuity_errors == 1 and lost.errors
    bad = bytearray(raw)
    bad[188 + 10] ^= 1  # the program map's checksum fails
    assert ts_media.read(bytes(bad)).errors and not ts_media.read(bytes(bad)).payload
    r = np.random.default_rng(1)
    for _ in range(50):
        ts_media.read(bytes(r.integers(0, 256, int(r.integers(0, 900)), np.uint8)))
        noisy = bytearray(raw)
        for k in r.integers(0, len(raw), 40):
            noisy[k] = int(r.integers(0, 256))
        ts_media.read(bytes(noisy))
    assert ts_media.section_crc(b"123456789") == 0x0376E6E7


def test_media_query(docs):
    got = {r.doc_id: r for r in ts_media.digests(ts_media.read_streams(ts_media.to_streams(docs))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(ts_media.write(payload)).hexdigest() and r.feature.endswith("errors=0+0")
    assert ts_media.to_streams(empty(docs)).count() == 0


# -- licences ---------------------------------------------------------------------
def plain_scan(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    joined, found = f" {' '.join(w)} ", []
    for rule in license_scan.rules():
        if rule.keyword in joined:
            for m in re.finditer(rule.regex, joined):
                at = joined[: m.start()].count(" ")
                found.append((at, at + m[0].count(" "), rule.priority, rule.confidence, rule.label))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[4], d[3]))
    kept = [d for k, d in enumerate(found) if not any(e[1] >= d[1] and e[2] >= d[2] for e in found[:k])]
    more = labels | {d[4] for d in kept}
    score = max([0.0, *(d[3] for d in kept), *([0.7] if starts else [])])
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score


def test_license_scan(spark, docs):
    more = ["Licensed under the Apache License, Version 2.0. See the GNU General Public License v3.0 for details.", "CC BY-NC 4.0 cc by cc by", "SPDX-License-Identifier: GPL-2.0-only", "the mit license mit license and all rights reserved", "This is released under MIT License. " * 40, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs.select("doc_id", "text").union(extra)).collect()}
    for i, t in [*enumerate(TEXTS), *((100 + i, t) for i, t in enumerate(more))]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(t), t
    assert len(license_scan.rules()) > 200
    assert all(any(g.strip() in r.keyword or g.strip() in r.regex for g in license_scan.GATES) for r in license_scan.rules())
    assert license_scan.scan(empty(docs)).count() == 0


# -- exact dedup ------------------------------------------------------------------
def test_exact_dedup(spark, docs):
    copies = spark.range(40).selectExpr("1000 + id as doc_id", "concat('same', repeat(' ', 1 + cast(id % 3 as int)), 'text') as text")
    rows = docs.select("doc_id", "text").union(copies)
    want: dict = {}
    for r in rows.collect():
        want.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), []).append(r.doc_id)
    got = exact_dedup.exact_groups(rows).collect()
    assert len(got) == rows.count()
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by[r.text_sha256]
        best = min((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), best is None or r.doc_id == best)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0


# -- quality ----------------------------------------------------------------------
def test_quality(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("aeinorst"), 5))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(60)]
    bad = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, "x" * 5000), (None, good[0]), (0, good[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_mil.evaluate(docs, labels).collect()}
    assert len(got) == 123 and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    assert [got[i].predicted for i in range(120)] == [1] * 60 + [0] * 60
    model = quality_mil.train(docs, labels)
    kept = quality_mil.accept(docs.withColumnRenamed("doc_id", "id"), model)
    assert kept.columns == ["id", "text"] and {x.id for x in kept.collect()} >= set(range(60))
    assert quality_mil.train(docs, labels.limit(0)).constant == 1.0
    assert quality_mil.score(docs.limit(0), model).count() == 0


def test_quality_gradients():
    x, many = quality_mil.passages(["one two three " * 40, "ABC!! " * 90, ""])
    y, g = np.array([1.0, 0.0, 1.0]), quality_mil.GatedAttention()
    f = g.forward(x, many)
    grads = g.gradients(x, f, f["score"] - y)

    def loss():
        s = g.forward(x, many)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    for name, p in g.p.items():
        at = (0,) * p.ndim
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6
