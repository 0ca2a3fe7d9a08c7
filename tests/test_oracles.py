"""Queries against their SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from sacbe.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 6) if isinstance(v, (int, float, Decimal)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    got = db.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert rows == want
