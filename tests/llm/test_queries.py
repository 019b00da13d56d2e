"""The registered queries against their SQL over the smallest tables."""

import duckdb
import pytest

from strandloom.llm.queries import ORACLE_SQL, QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{TINY}/{table}.parquet'")
    got = QUERIES[name](spark, TINY)
    cols = sorted(got.columns)
    rows = sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect())))
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(str, want)) and rows
