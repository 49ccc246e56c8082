"""Every registered query of the core over the smallest tables, against its SQL where it has one."""

import glob
import os

import pytest

from vellumflow.plans import archive, ledger, preparation

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = archive.QUERIES | ledger.QUERIES | preparation.QUERIES
ORACLES = archive.ORACLES | ledger.ORACLES | preparation.ORACLES


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return round(x, 6)
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
        assert got == want
