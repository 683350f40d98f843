"""What a Python worker holds at once, by the memory that the operators' functions take."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import near_dup, quality_mil, substring_dedup
from quarry.llm._common import slices
from quarry.llm._words import Rolling


class Local:
    """Stands in for a DataFrame: mapInArrow runs here."""

    def __init__(self, batch):
        self.batch, self.schema = batch, batch.schema

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


@pytest.fixture(scope="module")
def batch():
    letters = np.random.default_rng(3).integers(97, 123, 3_900_000).astype(np.uint8)
    letters[::6] = 32
    texts = [letters[k : k + 3900].tobytes().decode() for k in range(0, len(letters), 3900)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "tag": [0] * len(texts), "text": texts})


def peak(f):
    f()  # tables that stay
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_anchors(batch):
    assert peak(lambda: substring_dedup.anchors(Local(batch))) < 200


def test_accept(batch):
    model = quality_mil.GatedAttention()
    assert peak(lambda: quality_mil.accept(Local(batch), model)) < 100


def test_slices():
    texts = ["a" * 300, None, "", "b" * 5000, "c", "d" * 900, "e" * 900]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = [s.column(0).to_pylist() for s in slices(batch, "text", 1000)]
    assert sum(got, []) == texts and len(got) > 2 and all(sum(len(t or "") for t in s[1:]) <= 1000 for s in got)
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_worker_lets_go(batch):
    """What the pipeline's workers keep once a task is done stays beside an executor's next stage."""
    model = quality_mil.GatedAttention()
    docs = Local(batch)
    for f in (lambda: quality_mil.accept(docs, model), lambda: substring_dedup.anchors(docs), lambda: near_dup.signatures(docs, 5, 6, 32), lambda: near_dup.sets_of(docs, 5)):
        f()
        assert sum(p.nbytes for p in Rolling._powers) < 1000
