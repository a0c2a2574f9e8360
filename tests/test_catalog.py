"""Every query of the catalog against DuckDB on the smallest tables; needs the given tables."""

import os

import duckdb
import pytest

from quernstone.plans import catalog
from quernstone.views import TABLES, with_views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("key", sorted(catalog.TEXTS))
def test_query(spark, duck, key):
    df = catalog.queries()[key](spark, DATA)
    found = duck.execute(catalog.checks()[key])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in df.columns]) for r in found.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


def test_views_come_in_order():
    text = with_views("SELECT * FROM v_conversations")
    assert text.index("v_messages AS") < text.index("v_conversations AS")
