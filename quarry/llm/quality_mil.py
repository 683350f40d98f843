"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded
(byte classes, word shapes and repetition, then a learned layer); gated
attention, learned from document labels alone, weighs the passages, and the
weighted mean of their encodings is scored.

The fit runs on the driver over a bounded sample: at most SAMPLE labelled
documents of each label, those with the smallest hashes, with whole texts.
Rows whose crc32(id as text) mod 5 is 0 are held out. Only the text enters a
score. Scoring is one pass without a shuffle.

Nulls: a null text is an empty one (one passage without words, score as
learned); a null id is scored, and counts as held out as its text is unknown.
Repeated rows get equal scores. Labels that are null or have no document are
not used; without labels of both kinds the score is the share of label 1
(1 without any). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import frugal, slices, text_batches, text_or_empty
from quarry.llm._words import Rolling, bounds, joined

PASSAGE = 64
SAMPLE = 2500
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 40, 128, 0.01, 1e-4, 7
THRESHOLD = 0.3

_CLASSES = np.full(256, 6, np.int8)
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[[9, 10, 11, 12, 13, 32]] = 3
_CLASSES[[ord(c) for c in ".,;:"]] = 4
_CLASSES[ord("!")] = 5
_CLASSES[128:] = 7
_INNER = _CLASSES != 3


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 at least)."""
    raw, at = joined([t.encode() for t in texts], b"\n")
    start, end = bounds(raw, _INNER)
    first = np.searchsorted(start, at)
    words = np.diff(first)
    many = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(texts)), words)
    mine = base[doc] + (np.arange(len(start)) - first[doc]) // PASSAGE
    total = int(base[-1])
    n = np.bincount(mine, minlength=total).astype(float)
    safe = np.maximum(n, 1)
    heads = np.searchsorted(mine, np.arange(total))
    tails = np.searchsorted(mine, np.arange(total), side="right") - 1
    full = n > 0
    lo, hi = np.zeros(total, np.int64), np.zeros(total, np.int64)
    lo[full], hi[full] = start[heads[full]], end[tails[full]]
    kinds = _CLASSES[raw]
    size = np.maximum(hi - lo, 1)
    cols = []
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        cols.append((sums[hi] - sums[lo]) / size)
    mean = lambda v: np.bincount(mine, v, minlength=total) / safe
    length = (end - start).astype(float)
    hashes = Rolling(raw).span(start, end)
    tagged = hashes + mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct = np.bincount(mine[np.unique(tagged, return_index=True)[1]], minlength=total) / safe
    again = np.zeros(len(start))
    again[1:] = (hashes[1:] == hashes[:-1]) & (mine[1:] == mine[:-1])
    last, lead = kinds[end - 1], kinds[start]
    cols += [
        np.log1p(n) / 4, mean(length) / 8, np.sqrt(mean(length**2)) / 8, distinct, mean(again),
        mean((last == 6).astype(float)), mean((last == 5).astype(float)), mean((last == 4).astype(float)), mean((lead == 1).astype(float)), mean((length == 1).astype(float)),
    ]
    return np.column_stack(cols), many


N_FEATURES = 18


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class GatedAttention:
    """h = tanh(xW + b); weights softmax(w . tanh(hV) * sigmoid(hU)); score of the weighted h."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        shape = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: r.normal(0, 0.3, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def forward(self, x: np.ndarray, many: np.ndarray) -> dict:
        p, at = self.p, np.cumsum(many) - many
        doc = np.repeat(np.arange(len(many)), many)
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a = e / np.add.reduceat(e, at)[doc]
        z = np.add.reduceat(a[:, None] * h, at)
        return {"at": at, "doc": doc, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, f: dict, error: np.ndarray) -> dict:
        p, h, t, g, a, doc = self.p, f["h"], f["t"], f["g"], f["a"], f["doc"]
        back = error[doc, None] * p["c"]
        gain = (h * back).sum(1)
        de = a * (gain - np.add.reduceat(a * gain, f["at"])[doc])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        pre = (a[:, None] * back + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": ((x - self.mean) / self.scale).T @ pre, "b": pre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> GatedAttention:
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 1.0
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        r, step = np.random.default_rng(SEED), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                x, many = np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some])
                f = self.forward(x, many)
                grads = self.gradients(x, f, (f["score"] - labels[some]) * weight[some] / len(some))
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for n, q in self.p.items():
                    d = grads[n] + DECAY * q
                    m[n] = 0.9 * m[n] + 0.1 * d
                    v[n] = 0.999 * v[n] + 0.001 * d**2
                    q -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.full(len(many), self.constant) if self.constant is not None else self.forward(x, many)["score"]


def _bags(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in text_batches(batches, chars=1_000_000):
            x, many = passages([t for _, t in some])
            cut = np.split(x.astype(np.float64), np.cumsum(many)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([c.ravel() for c in cut], pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(frugal(run), "doc_id long, x array<double>")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    """Fits on at most sample documents of each label."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for y in (0, 1)]
    truth = {r["doc_id"]: r["y"] for some in chosen for r in some}
    spark = docs.sparkSession
    picked = spark.createDataFrame([(d,) for d in truth], "doc_id long")  # at most 2 * sample ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    got = sorted((r["doc_id"], r["x"]) for r in _bags(rows.join(F.broadcast(picked), "doc_id", "left_semi")).toLocalIterator())
    bags = [np.array(x).reshape(-1, N_FEATURES) for _, x in got]
    return GatedAttention().fit(bags, np.array([truth[d] for d, _ in got], float))


def score(docs: DataFrame, model: GatedAttention, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every document, and the columns in keep."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        for some in text_batches(batches, chars=1_000_000):
            s = model.score(*passages([t for _, t in some]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(frugal(run), "doc_id long, score double")


def accept(docs: DataFrame, model: GatedAttention, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they are."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                good = model.score(*passages(texts)) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(frugal(run), docs.schema)


def evaluate(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, sample=sample))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
