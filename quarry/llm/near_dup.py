"""Near-duplicate documents by one-permutation MinHash.

A document's set holds the distinct SHINGLE-word shingles of its words (A-Z
lowered). One hash of each shingle gives both its bin and its rank there: the
smallest per bin is kept (one permutation), and an empty bin copies the bin
that a universal hash sequence of its own finds first (optimal densification).
Rows of ROWS bins form BANDS bucket keys.

Equal sets are one class from the start. Within a bucket, candidate edges are
a star: all members against the one that shares most buckets with others, so
their number is linear in the members. A candidate is confirmed on the full sets,
and confirmed links join classes into components. A bucket within one component is
finished. The members of all others are the rest, between whose components a star may
have left links: these are found exactly, by a set-similarity join of the rest on
prefixes of their full sets in the order of rarity (quarry.llm._rare), again by stars:
a group's members outside its largest component are hubs in turn, WIDTH times as many in each
round, until those that were no hub are one component. No cap drops a pair.

At Jaccard 0.8 a pair shares no bucket with a chance of 6e-5 (ROWS 6, BANDS 32).

Nulls: a null text has no words, an empty set, and no links. A null id is
null in the result, is its own component and is kept. Rows that share an id
are one document, linked with what any of them is linked with. Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.llm._common import Scratch, frugal, text_batches, text_or_empty
from quarry.llm._graph import components, joined_components
from quarry.llm._rare import may_match, rare_prefixes
from quarry.llm._words import Rolling, bounds, joined, mix
from quarry.llm.exact_dedup import RunTree

ROWS, BANDS, WIDTH = 6, 32, 8
NUMERATOR, DENOMINATOR = 80, 100

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = np.ones(256, bool)
_INNER[[32, 9, 10, 11, 12, 13]] = False


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, of all as one."""
    raw, at = joined([t.encode() for t in texts], b"\n")
    raw = _LOWER[raw]
    start, end = bounds(raw, _INNER)
    words = Rolling(raw).span(start, end)
    n = len(words)
    first = np.searchsorted(start, at)
    whole = words.copy()
    for k in range(1, shingle):
        whole[: n - k] = mix(whole[: n - k] * _U(0x9E3779B97F4A7C15) + words[k:] + _U(k)) if n > k else whole[: max(0, n - k)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h * _U(0xC2B2AE3D27D4EB4F) + words[k : k + 1])
            out.append(h ^ _U(b - a))
        else:
            out.append(words[:0])
    return out


def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures (len(sets), bins) of sets that are not empty."""
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    cell = doc * bins + ((every >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sets are sorted, so the first of a bin is its smallest
    sig, filled = np.zeros(len(sets) * bins, _U), np.zeros(len(sets) * bins, bool)
    sig[cell[head]], filled[cell[head]] = every[head], True
    empty = np.flatnonzero(~filled)
    step = 0
    while len(empty):
        step += 1
        own = empty % bins
        donor = empty - own + (mix(own.astype(_U) + _U(step << 20)) % _U(bins)).astype(np.int64)
        ok = filled[donor]
        sig[empty[ok]] = sig[donor[ok]]
        empty = empty[~ok]
    return sig.reshape(len(sets), bins)


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), _U) + np.arange(1, bands + 1, dtype=_U)
    for k in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + sig[:, k : rows * bands : rows])
    return keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set, null if empty), keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_batches(batches, chars=1_000_000):
            sets = shingle_sets([t for _, t in some], shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                for k, row in zip(full, band_keys(densified([sets[k] for k in full], rows * bands), rows, bands)):
                    keys[k] = row
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in some], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    return docs.mapInArrow(frugal(run), "doc_id long, n_shingles long, digest binary, keys array<long>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, hashes: the whole set of each document, sorted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_batches(batches, chars=1_000_000):
            sets = [s.view(np.int64) for s in shingle_sets([t for _, t in some], shingle)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return docs.mapInArrow(frugal(run), "doc_id long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, least: int, of: int) -> DataFrame:
    """The rows (a, b) of pairs whose full sets have of * intersection >= least * union."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(of * both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _link_rest(scratch: Scratch, rest: DataFrame, sets: DataFrame, named: DataFrame, least: int, of: int) -> DataFrame:
    """named (node, component) after all links between the nodes of rest."""
    full = sets.join(rest.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.first("hashes").alias("tokens"))
    full = scratch.keep(full, "rest_sets")
    rows = scratch.keep(rare_prefixes(full, ["node"], [], least, of), "entries")
    scratch.drop(full)
    width = 1
    while True:
        state = rows.join(named, "node", "left").select("token", "node", "n", "rest", F.coalesce("component", "node").alias("component"))
        parts = state.groupBy("token", "component").agg(F.count("*").alias("m"))
        split = parts.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("base"), F.count("*").alias("parts")).where("parts > 1").select("token", "base")
        state = scratch.keep(state.join(split, "token"), "open")
        scratch.drop(rows)
        if state.isEmpty():
            scratch.drop(state)
            return named
        turn = F.row_number().over(Window.partitionBy("token").orderBy("node"))
        hubs = state.where("component <> base").withColumn("turn", turn).where(F.col("turn") <= width)
        hubs = scratch.keep(hubs.select("token", F.struct("node", "component", "n", "rest").alias("hub")), "hubs")
        pairs = state.join(hubs, "token").where((F.col("hub.component") != F.col("component")) & may_match(least, of))
        pairs = pairs.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()
        links = scratch.keep(confirmed(pairs, sets, least, of), "links")
        named = named if links.isEmpty() else joined_components(named, links)
        met = hubs.select("token", "hub.node")
        rows = scratch.keep(state.join(met, ["token", "node"], "left_anti").select("token", "node", "n", "rest"), "entries")
        scratch.drop(state, hubs, links)
        width *= WIDTH


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: int = NUMERATOR, of: int = DENOMINATOR, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(own, shingle, rows, bands), "signatures")
    tree = RunTree(signed.where("digest is not null").select("digest", "doc_id", "n_shingles", "keys"), ["digest"], more={"size": F.first("n_shingles"), "keys": F.first("keys")})
    classes = scratch.keep(tree.top, "classes")
    member = classes.where("best is not null").select(F.explode("keys").alias("bucket"), F.col("best").alias("node"), "size")
    many = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.keep(member.join(many, "bucket"), "shared")
    # the hub of a bucket is the member that shares most with others: of a text and its edited copies, the text
    weight = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    member = shared.join(weight, "node")
    star = member.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "size")).alias("hub"))
    member = scratch.keep(member.join(star, "bucket").select("bucket", "node", "size", (-F.col("hub.minus")).alias("hub"), F.col("hub.size").alias("hub_size")), "members")
    scratch.drop(shared)
    sets = scratch.keep(sets_of(own.join(member.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle), "sets")

    fits = f"{of} * least(size, hub_size) >= {least} * greatest(size, hub_size)"
    tested = member.where("node <> hub").where(fits).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = scratch.keep(confirmed(tested, sets, least, of), "links")
    named = components(links)
    state = member.join(named, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = state.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other")
    rest = scratch.keep(state.join(split, "bucket", "left_semi").select("node").distinct(), "rest")
    named = _link_rest(scratch, rest, sets, named, least, of)
    scratch.drop(member, links, rest, sets)

    best = classes.join(named, classes["best"] == named["node"], "left").select("digest", F.coalesce("component", "best").alias("component_id"))
    linked = tree.down(best, "component_id").select("doc_id", "n_shingles", "component_id")
    lone = signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.union(lone)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()).alias("kept"))
