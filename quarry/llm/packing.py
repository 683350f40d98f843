"""Sequence packing by non-negative least squares over a length histogram.

Every document is tokenised and closed with an end id. Whole windows are cut
off; what is left of each document is packed block by block: lengths are
binned, combinations of at most three bins that fill the window are
enumerated, their repeat counts are solved against the block's histogram
(Lawson and Hanson's active-set method), rounded and dealt out. Residuals are
laid end to end and cut at window ends; the last, partial window is cut at
powers of two, which need no padding.

A block is a bounded run of one input partition, so nothing is shuffled, the
memory of a task is bounded, and a lost task is repeated alone.

Nulls: a null text is an empty one (its end id only); a null id stays null.
Repeated rows are packed as often as they occur. An empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm._common import frugal, text_batches, text_or_empty
from quarry.llm._words import CodeStore, Rolling, bounds, joined, ragged

WINDOW, END_ID = 2048, 1
#: Lengths are binned by this many tokens before the solve.
BIN = 16
#: A block is packed when it holds so many tokens or documents.
BLOCK_TOKENS, BLOCK_DOCS = 12_000_000, 60_000
CACHE_WORDS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Encodes with a BPE file of tokenizers whose pre-tokens never span white
    space and whose words end in a marked token.

    Texts are split at blanks and line feeds, which the pre-tokeniser drops.
    What a word gives is memoised; the words of a batch that are new are split
    into pre-tokens together, and new pre-tokens pass through the model in one
    call. Words beyond plain Latin take the library's own steps.
    """

    plain = re.compile("[\x21-\x7e\u00a1-\u024f]+")
    gap = b"\xff\xff\xff\xff"

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+|\n").findall
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: level.pre_tokenize_str(c)[0][0][-1] for c in map(chr, range(256)) for b in c.encode()[-1:]}
        shown |= {c.encode()[0]: level.pre_tokenize_str(c)[0][0][0] for c in map(chr, range(128, 0x250))}
        self.shown = {b: s for b, s in shown.items() if b != 10}
        vocab = self.bare.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.store = CodeStore(self._learn, cache)
        self.pieces: dict[str, bytes] = {}
        self.inner = np.ones(256, bool)
        self.inner[[10, 32]] = False

    def _new_pieces(self, pieces: list[str]) -> None:
        shown = "\n".join(pieces).encode().decode("latin-1").translate(self.shown)
        ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(at) != len(pieces) + 1:
            raise ValueError("the model's words do not end in a marked token")
        raw = ids.tobytes()
        self.pieces.update(zip(pieces, map(raw.__getitem__, map(slice, at, at[1:]))))

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > self.store.limit:
            self.pieces = {}
        text = [w.decode() for w in words]
        plain = [bool(self.plain.fullmatch(t)) and "<|" not in t for t in text]
        found = self.split("\n".join([t for t, p in zip(text, plain) if p]).lower())
        new = set(found).difference(self.pieces)
        new.discard("\n")
        if new:
            self._new_pieces(list(new))
        self.pieces["\n"] = self.gap
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), "<u4")
        cuts = np.flatnonzero(ids == 0xFFFFFFFF)
        counts = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        ids = ids[ids != 0xFFFFFFFF]
        if all(plain):
            return ids, counts
        easy, out = iter(np.split(ids, np.cumsum(counts)[:-1])), []
        for t, p in zip(text, plain):
            out.append(next(easy) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int64))
        return np.concatenate(out), np.array([len(x) for x in out])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        raw, at = joined([t.encode() for t in texts], b"\n")
        start, end = bounds(raw, self.inner)
        slot = self.store.slots_of(raw, start, end, Rolling(raw).span(start, end))
        length = self.store.length[slot]
        ids = self.store.codes[ragged(self.store.offset[slot], length)].astype("<u4").tobytes()
        done = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, at)] * 4
        return list(map(ids.__getitem__, map(slice, done[:-1].tolist(), done[1:].tolist())))


def combinations(n: int) -> np.ndarray:
    """All multisets of at most three bins 1..n that sum to n, padded with 0."""
    pairs = [(i, n - i, 0) for i in range(1, n // 2 + 1)]
    triples = [(i, j, n - i - j) for i in range(1, n // 3 + 1) for j in range(i, (n - i) // 2 + 1)]
    return np.array([(n, 0, 0), *pairs, *triples])


def nnls(rows: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """min |Ax - target| over x >= 0, where column c of A counts the bins that
    rows[c] names. Active-set method; several of the columns with the steepest
    gradient enter at once."""
    n, m = len(target), len(rows)
    a = np.zeros((n + 1, m))
    for k in range(rows.shape[1]):
        np.add.at(a, (rows[:, k], np.arange(m)), 1)
    a = a[1:]
    x, passive = np.zeros(m), np.zeros(m, bool)
    tol = 1e-6 * max(1.0, np.abs(target).max())
    gram = lambda p: a[:, p].T @ a[:, p] + 1e-9 * np.eye(len(p))
    for _ in range(rounds):
        slope = a.T @ (target - a @ x)
        slope[passive] = -np.inf
        enter = np.argpartition(-slope, min(16, m - 1))[:16]
        enter = enter[slope[enter] > tol]
        if not len(enter):
            break
        passive[enter] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.linalg.solve(gram(p), a[:, p].T @ target)
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            old = x[p][bad]
            step = np.min(old / np.maximum(old - z[bad], 1e-12)) if len(old) else 0
            new = x[p] + step * (z - x[p])
            new[bad & (new <= 1e-9)] = 0
            x[p] = new
            passive[p[bad & (new <= 1e-9)]] = False
            if not passive.any():
                return x
    return x


class Packer:
    """Packs blocks of (document, tokens); yields rows of PIECES in tuples."""

    def __init__(self, window: int = WINDOW, bin_width: int = BIN):
        self.window, self.bin = window, bin_width
        self.combos = combinations(window // bin_width)

    def pack(self, docs: list[tuple], first_id: int) -> tuple[list[tuple], int]:
        """docs: (id, ids as bytes). Rows, and the next free sequence id."""
        w, out, seq = self.window, [], first_id
        rest: list[tuple[int, int]] = []  # document, its start
        for k, (_, ids) in enumerate(docs):
            n = len(ids) // 4
            for start in range(0, n - n % w, w):
                out.append((k, start, w, seq, 0))
                seq += 1
            if n % w:
                rest.append((k, n - n % w))
        size = np.array([len(docs[k][1]) // 4 - start for k, start in rest], np.int64)
        bins = -(-size // self.bin)
        stacks: list[list[int]] = [[] for _ in range(w // self.bin + 1)]
        for r in np.lexsort((-np.arange(len(size)), size)).tolist():
            stacks[bins[r]].append(r)
        if rest:
            counts = np.bincount(bins, minlength=w // self.bin + 1)[1:].astype(float)
            x = np.rint(nnls(self.combos, counts, rounds=60)).astype(int)
            for c in np.argsort(-x, kind="stable"):
                if x[c] <= 0:
                    break
                need = [b for b in self.combos[c].tolist() if b]
                for _ in range(x[c]):
                    if any(len(stacks[b]) < need.count(b) for b in need):
                        break
                    at = 0
                    for b in need:
                        r = stacks[b].pop()
                        k, start = rest[r]
                        out.append((k, start, int(size[r]), seq, at))
                        at += int(size[r])
                    seq += 1
        left = [r for stack in reversed(stacks) for r in reversed(stack)]
        total, at, room = int(sum(size[r] for r in left)), 0, 0
        for r in left:
            k, start = rest[r]
            todo = int(size[r])
            while todo:
                if not room:
                    room = w if total >= w else 1 << (total.bit_length() - 1)
                    total, at = total - room, 0
                    seq += 1
                take = min(room, todo)
                out.append((k, start, take, seq - 1, at))
                start, todo, room, at = start + take, todo - take, room - take, at + take
        rows = []
        for k, start, length, s, at in out:
            doc_id, ids = docs[k]
            rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, s, at))
        return rows, seq


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, and with with_ids the piece's ids as bytes.

    tokenizer: path of a tokenizers file, the same on every executor.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, packer, end = WordTokenizer(tokenizer), Packer(window), array("I", [end_id]).tobytes()
        seq, block, held = TaskContext.get().partitionId() << 33, [], 0

        def flush(seq: int) -> tuple[list, int]:
            rows, seq = packer.pack(block, seq)
            ids = {} if not with_ids else {"ids": []}
            if with_ids:
                by_id = [(r, ids_of) for r, ids_of in zip(rows, packer_ids(block, rows))]
                ids["ids"] = [x for _, x in by_id]
            out = []
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                cols = [pa.array(c, pa.int64()) for c in zip(*part)]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    cols.append(pa.array(ids["ids"][at : at + 20_000], pa.binary()))
                    names = [*names, "ids"]
                out.append(pa.RecordBatch.from_arrays(cols, names))
            return out, seq

        def packer_ids(docs_in: list, rows: list) -> list[bytes]:
            by: dict = {}
            for doc_id, ids in docs_in:
                by.setdefault((doc_id, len(ids) // 4), []).append(ids)
            # repeated ids with equal lengths and different texts are told apart by their checksum
            return [next(x[4 * r[1] : 4 * (r[1] + r[2])] for x in by[(r[0], r[4])] if zlib.crc32(x[4 * r[1] : 4 * (r[1] + r[2])]) == r[3]) for r in rows]

        for some in text_batches(batches):
            for (doc_id, _), ids in zip(some, words.encode_batch([t for _, t in some])):
                block.append((doc_id, ids + end))
                held += len(ids) // 4 + 1
            if held >= BLOCK_TOKENS or len(block) >= BLOCK_DOCS:
                batches_out, seq = flush(seq)
                yield from batches_out
                block, held = [], 0
        if block:
            batches_out, seq = flush(seq)
            yield from batches_out

    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), PIECES + (", ids binary" if with_ids else ""))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, and the share of padded places."""
    from pyspark.sql import functions as F

    seqs = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = (F.col("n") > 0) & (F.col("n").bitwiseAND(F.col("n") - 1) == 0)
    full = F.when(power, F.col("n")).otherwise(F.lit(window))
    return seqs.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), (1 - F.sum("n") / F.sum(full)).alias("padding"))
