"""Spark results equal the SQL equivalents on the shared tables (smallest scale)."""

from pathlib import Path

import pytest

from ledgermill.catalog.oracle import ORACLE
from ledgermill.catalog.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
CHECKED = ["normalize_orders", "candidate_counts", "best_match_referenced", "reconcile_ab", "reconcile_abc", "remittance_schedule",
           "evidence_index", "three_way_schedule"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="shared tables absent")
@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    want = sorted(repr([str(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([str(v) for v in r]) for r in df.select(*sorted(names)).collect())
    assert got == want
