"""Every registered query of the engine against its SQL twin."""

from __future__ import annotations

import duckdb
import pytest

from quarry.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "part orders lineitem events documents embeddings conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    rows = got.collect()
    if name in registry.SQL:
        want = con.sql(registry.SQL[name])
        assert _rows(got.columns, rows) == _rows(want.columns, want.fetchall())
    else:
        assert len(got.columns)
