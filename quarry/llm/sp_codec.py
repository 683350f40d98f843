"""SentencePiece encoding and decoding that keeps byte offsets.

A text is normalised through the model's compiled character map: at each
place the longest source prefix that the map's trie holds is replaced, and the
source byte of every normalised byte is recorded. The normalised text is cut
before each run of blank marks (no piece of such a model crosses a cut), every
segment is split into pieces once, by merges of the best-ranked neighbours, and
memoised, and the pieces' ends are projected through the alignment back to byte
spans of the original text. An empty map is the identity, in one step.

Nulls: a null text is an empty one, which has only the end id. A null id stays
null, repeated rows are encoded each, an empty table gives no rows. Very long texts
are normalised whole, in linear time; of the input only the id and the text are
read, so no further column can clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import text_batches, text_or_empty
from quarry.llm._words import CodeStore, Rolling, joined, ragged

MARK = "▁"
CACHE_SEGMENTS = 600_000
#: Segments of at most so many characters are merged many at a time.
SHORT = 64
NEVER = 1 << 40
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spans long, span_bytes long"


class CharMap:
    """The compiled character map: a double-array trie and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest prefix of text[at:] in the trie, and its replacement."""
        units, best, node = self.units, (0, b""), 0
        if not units:
            return best
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (k + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return best

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset of each (and of the end)."""
        if not self.units:  # no prefix of any text is in an empty trie
            return text, np.arange(len(text) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(text):
            n, new = self.longest(text, at)
            if not n:
                lead = text[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[at : at + n]
                source += range(at, at + n)
            else:
                source += [at] * len(new)
            out += new
            at += n
        return bytes(out), np.array([*source, at])


class Symbols:
    """Numbers for pieces and characters, and which neighbours merge: a pair's rank and
    symbol are found by the pair's key in sorted arrays."""

    def __init__(self, rank: dict[str, tuple[float, int]]):
        chars = sorted({c for p in rank for c in p if c not in rank})
        number = {p: k for k, p in enumerate([*rank, *chars])}
        self.piece = np.array([*(k for _, k in rank.values()), *(-1 for _ in chars), -1], np.int64)
        #: Characters of no piece come after all others, by code point.
        self.first_other = len(number)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.first_other
        self.chars = [c for c in number if len(c) == 1]
        self.of_char[[ord(c) for c in self.chars]] = [number[c] for c in self.chars]
        self.names = list(number)
        order = {score: k for k, score in enumerate(sorted({r for r, _ in rank.values()}))}
        self.width = self.first_other + 0x110000
        pairs = sorted((number[p[:k]] * self.width + number[p[k:]], order[rank[p][0]], number[p]) for p in rank for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.keys, self.rank, self.whole = (np.array(x, np.int64) for x in zip(*pairs))

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def ranks(self, symbol: np.ndarray, owner: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ranks of the neighbours i, i + 1; NEVER where they do not merge."""
        at, known = self._find(symbol[i], symbol[i + 1])
        return np.where(known & (owner[i] == owner[i + 1]), self.rank[at], NEVER)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.whole[self._find(left, right)[0]]

    def text(self, symbol: int) -> str:
        return self.names[symbol] if symbol < self.first_other else chr(symbol - self.first_other)


class Codec:
    """encode() and decode() for one model file."""

    def __init__(self, path: str, cache: int = CACHE_SEGMENTS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with blank marks in front of words is asked for")
        if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
            raise ValueError("a piece of this model crosses words")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.map, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.rank = {p.piece: (-p.score, k) for k, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.symbols = Symbols(self.rank)
        self.names = [str(k) for k in range(len(proto.pieces))]
        self.unknown, self.end = library.unk_id(), library.eos_id()
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == 6}
        self.spelled_ids = {self.unknown, *self.byte_ids.values()}
        self.byte_of = {k: b for b, k in self.byte_ids.items()}
        self.surface = [p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.width = np.array([1 if p.type == 6 else len(s) for p, s in zip(proto.pieces, self.surface)])
        self.store = CodeStore(self._learn, cache)
        self._fresh()

    def _fresh(self) -> None:
        self.shown: list[str] = []
        self.decoded: list[str] = []

    # -- pieces of one segment ------------------------------------------------
    def merge(self, segment: str) -> list[int]:
        """Pieces of a normalised segment (blank marks included): the best-ranked
        neighbours are merged first, the leftmost of equals."""
        ids: list[int] = []
        for p in self._merged_long(list(segment)):
            known = self.rank.get(p)
            ids += [known[1]] if known else self._spelled(p)
        return ids

    def _spelled(self, part: str) -> list[int]:
        """A character that is no piece."""
        return [self.byte_ids[b] for b in part.encode()] if self.byte_ids else [self.unknown]

    def _merged_short(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What merge() gives for each of many segments (none empty), one after another, and
        how many each has. In each round the best-ranked neighbours of every segment are
        merged, in arrays over all of them; segments without such neighbours are done."""
        length = np.array([len(x) for x in segments])
        code = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        symbol, owner = self.symbols.of_char[code], np.repeat(np.arange(len(segments)), length)
        rank = self.symbols.ranks(symbol, owner, np.arange(len(symbol) - 1))
        rank = np.append(rank, NEVER)
        done: list[tuple] = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best < NEVER
            done.append((owner[~open_], symbol[~open_]))
            symbol, owner, rank, best = symbol[open_], owner[open_], rank[open_], best[open_]
            if not len(symbol):
                break
            at = np.flatnonzero(rank == best)
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
            symbol[at] = self.symbols.merged(symbol[at], symbol[at + 1])
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            before = at[at > 0] - 1
            for i in (at[at + 1 < len(symbol)], before):
                rank[i] = self.symbols.ranks(symbol, owner, i)
            if at[-1] + 1 == len(symbol):
                rank[-1] = NEVER
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        ids = self.symbols.piece[np.minimum(symbol, len(self.symbols.piece) - 1)]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, np.bincount(owner, minlength=len(segments))
        spelled = [self._spelled(self.symbols.text(x)) for x in symbol[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in spelled]
        ids = np.repeat(ids, times)
        ids[ids < 0] = [i for x in spelled for i in x]
        return ids, np.bincount(np.repeat(owner, times), minlength=len(segments))

    def _merged_long(self, parts: list) -> list[str]:
        """By a heap of neighbours."""
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := self.rank.get(parts[i] + parts[j])):
                heapq.heappush(heap, (r[0], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p is not None]

    def _learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """segments: a blank (the mark) and what follows up to the next cut."""
        if not self.store.slots:
            self._fresh()
        text = [s.decode() for s in segments]
        short = [k for k, t in enumerate(text) if len(t) <= SHORT]
        ids: list = [None] * len(text)
        if short:
            codes, counts = self._merged_short([text[k].replace(" ", MARK) for k in short])
            listed, ends = codes.tolist(), np.cumsum(counts).tolist()
            for k, a, b in zip(short, [0, *ends], ends):
                ids[k] = listed[a:b]
        for k, t in enumerate(text):
            if ids[k] is None:
                ids[k] = self.merge(t.replace(" ", MARK))
        names = self.names
        self.shown += [" ".join([names[i] for i in x]) for x in ids]
        spelled = self.spelled_ids
        self.decoded += [t if spelled.isdisjoint(x) else self._surface(x) for t, x in zip(text, ids)]
        return np.array([k for x in ids for k in x], np.int64), np.array([len(x) for x in ids], np.int64)

    def _surface(self, ids: list[int]) -> str:
        raw = b"".join(bytes([self.byte_of[k]]) if k in self.byte_of else " ⁇ ".encode() if k == self.unknown else self.surface[k] for k in ids)
        return raw.decode("utf-8", "replace")

    # -- texts ----------------------------------------------------------------
    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes with blanks for marks, and their source offsets."""
        raw, source = self.map.apply(text.encode())
        if MARK.encode() in raw:  # a mark in the text is a blank to the model
            parts, kept, at = raw.split(MARK.encode()), [], 0
            for p in parts:
                kept.append(source[at : at + len(p) + 1])
                at += len(p) + 3
            kept[-1] = source[len(source) - len(parts[-1]) - 1 :]
            raw, source = b" ".join(parts), np.concatenate(kept)
        if self.squeeze:
            word = np.frombuffer(raw, np.uint8) != 32
            keep = np.flatnonzero(word | (np.append(False, word[:-1]) & np.logical_or.accumulate(word[::-1])[::-1]))
            raw, source = np.frombuffer(raw, np.uint8)[keep].tobytes(), source[np.append(keep, keep[-1] + 1 if len(keep) else 0)]
        if self.dummy and raw:
            raw, source = b" " + raw, np.concatenate([source[:1], source])
        return raw, source

    def encode_batch(self, texts: list[str]) -> list[tuple]:
        """For each text: ids (without an end id), span starts, span ends (bytes
        of the original), the ids in decimal, the decoded text."""
        norm, sources = zip(*map(self.normalise, texts)) if texts else ((), ())
        raw, at = joined(list(norm), b"")
        blank = raw == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        firsts = at[:-1][np.diff(at) > 0]
        cut[firsts] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw)) if len(start) else start
        slot = self.store.slots_of(raw, start, end, Rolling(raw).span(start, end))
        counts = self.store.length[slot]
        ids = self.store.codes[ragged(self.store.offset[slot], counts)]
        ends = np.cumsum(self.width[ids]) if len(ids) else ids
        words = np.searchsorted(start, at)
        pieces = np.concatenate([[0], np.cumsum(counts)])[words]
        slots, out = slot.tolist(), []
        for k in range(len(texts)):
            a, b = pieces[k], pieces[k + 1]
            mine = slots[words[k] : words[k + 1]]
            shown = " ".join([self.shown[i] for i in mine])
            back = "".join([self.decoded[i] for i in mine])
            stop = ends[a:b] - at[k]
            s = sources[k][np.concatenate([[0], stop[:-1]])] if b > a else stop
            stop = sources[k][stop]
            out.append((ids[a:b], s, stop, shown, back[1:] if self.dummy and back[:1] == " " else back))
        return out


@lru_cache(1)
def _codec(path: str) -> Codec:
    """One codec, with its memo, for all tasks of a worker."""
    return Codec(path)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, span_start, span_end (bytes of the original text), decoded;
    the end id closes ids and has no span."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(model)
        for some in text_batches(batches, chars=2_000_000):
            rows = codec.encode_batch([t for _, t in some])
            cols = [
                pa.array([d for d, _ in some], pa.int64()),
                pa.array([np.append(r[0], codec.end) for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                pa.array([r[4] for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "span_start", "span_end", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, span_start array<int>, span_end array<int>, decoded string")


def digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode() gives, as DIGESTS; the arrays stay in the worker."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for some in text_batches(batches):
            rows = codec.encode_batch([t for _, t in some])
            shown = [f"{r[3]} {codec.end}" if r[3] else str(codec.end) for r in rows]
            cols = [[d for d, _ in some], [len(r[0]) + 1 for r in rows], list(map(sha, shown)), [sha(r[4]) for r in rows], [len(r[1]) for r in rows], [int((r[2] - r[1]).sum()) for r in rows]]
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, cols)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, DIGESTS)
