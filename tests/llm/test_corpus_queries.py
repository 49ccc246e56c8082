"""Every registered query of the corpus operators over the smallest tables, against its SQL where it has one."""

import glob
import os

import pytest

from vellumflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FOUND = {"p1_found": {"cluster_id", "name_id"}, "p2_found": {"field_name", "term", "mark"}, "p3_found": {"name_id_a", "name_id_b"}, "p4_found": {"candidate_sha256"}, "p7_ids": {"doc_id", "ids"}, "p9_found": {"doc_id", "pii_kind", "start_pos"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in FOUND:
        assert set(df.columns) == FOUND[name]
        assert len({repr(r) for r in rows}) == len(rows)
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        cursor = con.execute(ORACLES[name])
        order = [[x[0] for x in cursor.description].index(c) for c in df.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
