"""Removal of long repeated strings through run-length BWT indexes.

A byte is removed if a string of LENGTH bytes that covers it also starts
anywhere else. The whole corpus cannot be one index, so places that can match
are first brought together:

1. Every window of LENGTH bytes has one anchor, its K-byte string of smallest
   hash. Windows that share an anchor are consecutive; their union is a span.
   Equal windows have equal anchors at equal places, so a window can repeat
   only among the spans of one anchor. Anchors that occur once end here.
2. The spans of an anchor that are equal are one entry with a count. An anchor
   whose spans are all equal is a single run: every window of it repeats.
3. Anchors with different spans go, whole, to index blocks of bounded size. A
   block's text is sorted into a suffix array, whose BWT is kept as runs with
   the suffixes at run heads sampled. Only sampled places compare text: the
   common prefix of a suffix with its predecessor falls by one from each place
   to the next within a run, so matching statistics stream from the samples.
   Neighbours that share LENGTH bytes form intervals, and an interval with two
   different places of the corpus marks all its places.

Nulls: a null text is an empty one. A row is known by two 64-bit hashes of its id
and whole text, so rows that share an id, or have none, are apart. Rows that repeat
both are different places, so their long strings repeat. Texts shorter than
LENGTH keep all bytes; very long ones are taken in parts. Empty tables give no rows.
Further columns travel in one struct, so none of their names clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm._common import frugal, partitions, slices, stage, text_or_empty
from quarry.llm._words import Rolling, joined

LENGTH, K = 200, 64
#: Bytes that one index block holds; an anchor's spans are never divided.
BLOCK = 500_000
#: An anchor's equal spans are counted within so many bytes of text before they are sent.
CHUNK = 24_000_000
#: Bytes of text whose windows are hashed at once: each costs a worker about 100 bytes of arrays.
PIECE = 1_000_000
_PLACES = (1 << 24) - 1
_SEED = np.uint64(0x5851F42D4C957F2D)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m, step = a, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def spans(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """For the windows of all texts, per anchor: text number, span start and
    length in that text, hash of the anchor, hash of the span (with the
    anchor's place in it)."""
    raw, at = joined(texts, b"")
    if len(raw) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) > _PLACES:
        raise ValueError("too many bytes at once")
    roll = Rolling(raw)
    place = np.arange(len(raw) - k + 1)
    h = roll.span(place, place + k)
    key = (h & ~np.uint64(_PLACES)) | place.astype(np.uint64)
    anchor = (_sliding_min(key, length - k + 1) & np.uint64(_PLACES)).astype(np.int64)
    window = np.arange(len(anchor))
    doc = np.searchsorted(at, window, side="right") - 1
    inside = window + length <= at[doc + 1]
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(inside & (change | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([change[1:] | ~inside[1:], [True]]))
    q, end = anchor[first], last + length
    own = roll.span(first, end) ^ ((q - first).astype(np.uint64) * _SEED)
    return doc[first], first - at[doc[first]], end - first, h[q], own


def _pieces(text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in overlapping parts; each window is whole in one of them."""
    for at in range(0, max(1, len(text) - LENGTH + 1), most - LENGTH + 1):
        yield at, text[at : at + most]


ANCHORS = "anchor long, span long, n int, doc_id long, tag long, lo int, len int, more array<struct<doc_id:long,tag:long,lo:int>>"


def anchors(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tag, text. ANCHORS: one row per span and chunk; n counts the
    chunk's equal spans, more lists those beyond the first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def flush() -> Iterator:
            cols = [np.concatenate(c) for c in zip(*held)]
            ids, tags, lo, size, h, s = cols
            order = np.lexsort((s, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(order)))
            at = order[head]
            rest = order[~new]
            offsets = np.concatenate([[0], np.cumsum(n - 1)])
            for a in range(0, len(head), 100_000):
                b = min(a + 100_000, len(head))
                some, others = at[a:b], rest[offsets[a] : offsets[b]]
                more = pa.ListArray.from_arrays(
                    pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(ids[others]), pa.array(tags[others]), pa.array(lo[others].astype(np.int32))], ["doc_id", "tag", "lo"]),
                )
                more = pa.compute.if_else(pa.array(n[a:b] > 1), more, pa.scalar(None, more.type)) if (n[a:b] > 1).any() else pa.nulls(b - a, more.type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[some].view(np.int64)), pa.array(s[some].view(np.int64)), pa.array(n[a:b].astype(np.int32)), pa.array(ids[some]), pa.array(tags[some]), pa.array(lo[some].astype(np.int32)), pa.array(size[some].astype(np.int32)), more],
                    ["anchor", "span", "n", "doc_id", "tag", "lo", "len", "more"],
                )

        import pyarrow.compute  # noqa: F401

        some, meta, size, total = [], [], 0, 0

        def take() -> None:
            doc, lo, length, h, s = spans(some)
            info = np.array(meta, np.int64).reshape(-1, 3)
            held.append((info[doc, 0], info[doc, 1], lo + info[doc, 2], length, h, s))

        for batch in batches:
            names = batch.schema.get_field_index
            for part in slices(batch, "text"):
                for d, t, text in zip(*(part.column(names(n)).to_pylist() for n in ("doc_id", "tag", "text"))):
                    raw = text.encode()
                    if len(raw) < LENGTH:
                        continue
                    for at, piece in _pieces(raw, PIECE):
                        if size and size + len(piece) > PIECE:
                            take()
                            some, meta, size = [], [], 0
                        some.append(piece)
                        meta.append((d, t, at))
                        size += len(piece)
                        total += len(piece)
                    if total > CHUNK:
                        take()
                        yield from flush()
                        held.clear()
                        some, meta, size, total = [], [], 0, 0
        if some:
            take()
        if held:
            yield from flush()

    return docs.mapInArrow(frugal(run), ANCHORS)


class RunLengthIndex:
    """A run-compressed BWT of several texts, with the suffixes at run heads sampled.

    order: the suffixes (places in the joined text) in order; heads: the ranks
    at which a BWT run begins; sampled: the common prefix with the predecessor
    there. common(): for every suffix in text order, its common prefix with its
    predecessor, streamed from the samples.
    """

    END = 0xFF  # not in UTF-8

    def __init__(self, texts: list[bytes]):
        gap = bytes([self.END]) * 8
        self.raw, self.at = joined(texts, gap)
        sizes = np.array([len(t) for t in texts])
        n = len(self.raw)
        stop = np.repeat(self.at[:-1] + sizes, sizes + 8)  # where each place's text ends
        place = np.arange(n)
        self.left = np.maximum(stop - place, 0)
        del stop
        longest = int(sizes.max()) if len(sizes) else 0
        padded = np.concatenate([self.raw, np.full(8, self.END, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[k : k + n]
        self.levels: list[tuple[int, np.ndarray]] = []
        rank, width = self._rank(key), 8
        while width < longest:
            self.levels.append((width, rank))
            after = np.full(n, n)  # an end sorts last, as END does
            ok = place[self.left > width]
            after[ok] = rank[ok + width]
            rank = self._rank(rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))
            width *= 2
        self.levels.append((width, rank))
        order = np.argsort(rank, kind="stable")
        self.order = order[self.left[order] > 0]
        bwt = np.where(np.isin(self.order, self.at), self.END, self.raw[self.order - 1]).astype(np.int64)
        head = np.ones(len(bwt), bool)
        # the places before text starts differ from each other, so each is a run
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == self.END)
        self.heads = np.flatnonzero(head)
        self.runs = bwt[self.heads]
        self.sampled = self._common_prefix(self.order[self.heads - 1], self.order[self.heads])
        if len(self.sampled):
            self.sampled[0] = 0

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.zeros(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))[: len(key)]
        return rank

    def _common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for width, rank in [*reversed(self.levels)]:
            for _ in range(2 if width == self.levels[-1][0] else 1):
                ok = (out + width <= most) & (rank[a] == rank[b])
                out[ok] += width
                a[ok] += width
                b[ok] += width
                a, b = np.minimum(a, len(self.raw) - 1), np.minimum(b, len(self.raw) - 1)
        for _ in range(8):
            ok = (out < most) & (self.raw[a] == self.raw[b])
            out[ok] += 1
            a[ok] += 1
            b[ok] += 1
            a, b = np.minimum(a, len(self.raw) - 1), np.minimum(b, len(self.raw) - 1)
        return out

    def common(self) -> np.ndarray:
        n = len(self.raw)
        reach = np.zeros(n, np.int64)  # place + common prefix never falls within a text
        reach[self.order[self.heads]] = self.order[self.heads] + self.sampled
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def repeated(texts: list[bytes], places: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the ranges that repeated strings cover. places: for each text
    an integer of its first byte; the byte after has the next one, and bytes
    with equal integers are one place of the corpus, which does not match itself."""
    index = RunLengthIndex(texts)
    common = index.common()
    number = np.repeat(np.arange(len(texts)), [len(t) + 8 for t in texts])
    order = index.order[index.left[index.order] >= length]
    if not len(order):
        return [[] for _ in texts]
    # suffixes that are too short stand between others only where those differ earlier
    same = np.zeros(len(index.order), bool)
    same[1:] = common[index.order[1:]] >= length
    broken = np.cumsum(~same)[index.left[index.order] >= length]
    head = np.flatnonzero(np.concatenate([[True], broken[1:] != broken[:-1]]))
    where = places[number[order]] + (order - index.at[number[order]])
    low, high = np.minimum.reduceat(where, head), np.maximum.reduceat(where, head)
    hit = np.zeros(len(index.raw), bool)
    hit[order[np.repeat(low != high, np.diff(np.append(head, len(order))))]] = True
    hits = np.flatnonzero(hit)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(hits):
        return out
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(hits) > length) | (np.diff(number[hits]) > 0)]))
    for a, b in zip(hits[cut].tolist(), hits[np.append(cut[1:], len(hits)) - 1].tolist()):
        k = int(number[a])
        base = int(index.at[k])
        out[k].append((a - base, b - base + length))
    return out


RANGES = "doc_id long, tag long, lo int, hi int"


def index_blocks(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """entries: anchor, counted (another equal span exists), doc_id, tag, lo,
    body, dealt by anchor and sorted by it. RANGES of what repeats in them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ranges(rows: list[tuple]) -> pa.RecordBatch:
            bodies = [r[5] for r in rows]
            keys = [int.from_bytes(hashlib.blake2b(b"%d %d" % (r[2], r[3]), digest_size=7).digest(), "big") for r in rows]
            places = np.array([(k << 6) + r[4] for k, r in zip(keys, rows)], np.int64)
            out = []
            for r, found in zip(rows, repeated(bodies, places)):
                if not r[1]:
                    out += [(r[2], r[3], r[4] + a, r[4] + b) for a, b in found]
            cols = [list(c) for c in zip(*out)] or [[], [], [], []]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "tag", "lo", "hi"])

        rows, held, last = [], 0, None
        for batch in batches:
            names = batch.schema.get_field_index
            for r in zip(*(batch.column(names(n)).to_pylist() for n in ("anchor", "counted", "doc_id", "tag", "lo", "body"))):
                if held >= block and r[0] != last:
                    yield ranges(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
                last = r[0]
        if rows:
            yield ranges(rows)

    return entries.mapInArrow(frugal(run), RANGES)


def _bodies(rows: DataFrame) -> DataFrame:
    """Cuts the wanted spans out of their texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.get_field_index
            for part in slices(batch, "text"):
                out = []
                for d, t, text, wanted in zip(*(part.column(names(n)).to_pylist() for n in ("doc_id", "tag", "text", "wanted"))):
                    raw = text.encode()
                    out += [(w["anchor"], w["counted"], d, t, w["lo"], raw[w["lo"] : w["lo"] + w["len"]]) for w in wanted]
                cols = [list(c) for c in zip(*out)]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "counted", "doc_id", "tag", "lo", "body"])

    return rows.mapInArrow(frugal(run), "anchor long, counted boolean, doc_id long, tag long, lo int, body binary")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tag, text. One row per document with repeats: doc_id, tag,
    ranges (array of lo, hi; they may overlap)."""
    n = partitions(docs.sparkSession)
    dealt = anchors(docs).repartition(n, "anchor")
    both = dealt.selectExpr(
        "*",
        "sum(n) over (partition by anchor) as total",
        "min(span) over (partition by anchor) <> max(span) over (partition by anchor) as mixed",
        "sum(n) over (partition by anchor, span) > 1 as counted",
        "row_number() over (partition by anchor, span order by doc_id, tag, lo) = 1 as leads",
    )
    both = stage(both.where("total > 1").drop("n", "span", "total"), "spans")
    whole = both.where("counted").select(F.explode(F.concat(F.array(F.struct("doc_id", "tag", "lo")), F.coalesce("more", F.expr("array()")))).alias("x"), "len")
    whole = whole.selectExpr("x.doc_id", "x.tag", "x.lo", "x.lo + len as hi")
    wanted = both.where("mixed and leads").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "counted", "lo", "len")).alias("wanted"))
    bodies = _bodies(docs.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "wanted"))
    parts = index_blocks(bodies.repartition(n, "anchor").sortWithinPartitions("anchor"))
    return whole.union(parts).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _cut(raw: bytes, ranges: list[dict]) -> tuple[list[bytes], int, int]:
    """What is left, bytes removed, runs removed."""
    lo = np.array([r["lo"] for r in ranges])
    hi = np.array([r["hi"] for r in ranges])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    starts, ends = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(hi)) - 1]
    keep = [raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)])]
    return keep, int((ends - starts).sum()), len(starts)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text, own = text_or_empty(text_col), F.col(id_col).cast("long")
    keys = F.xxhash64(own, text).alias("doc_id"), F.xxhash64(F.lit(1), text, own).alias("tag")
    return docs.select(*keys, text.alias("text"), own.alias("id"), *more)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: the
    bytes that are left), and, if keep names columns, row (a struct of them)."""
    row = [F.struct(*keep).alias("row")] if keep else []
    keyed = _keyed(docs, id_col, text_col, *row)
    ranges = repeated_ranges(keyed.select("doc_id", "tag", "text"))
    rows = keyed.join(ranges, ["doc_id", "tag"], "left").drop("doc_id", "tag")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.get_field_index
            for part in slices(batch, "text"):
                out = []
                for d, text, ranges in zip(*(part.column(names(n)).to_pylist() for n in ("id", "text", "ranges"))):
                    raw = text.encode()
                    left, gone, runs = _cut(raw, ranges) if ranges else ([raw], 0, 0)
                    out.append((d, len(raw), gone, runs, b"".join(left)))
                cols = list(zip(*out))
                kinds = [*[pa.int64()] * 4, pa.binary()]
                more = [part.column(names(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), *more], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(f.name for f in kept)])

    kept = [f for f in rows.schema.fields if f.name == "row"]
    out = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.mapInArrow(frugal(run), StructType([*out.fields, *kept]))


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


