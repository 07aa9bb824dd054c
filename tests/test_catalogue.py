"""Every registered query of the rules against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tagmill.plans import catalogue
from tagmill.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no sample tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
