"""Queries against their DuckDB text on the smallest tables."""

import duckdb
import pytest

from larder.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    expect = sorted(map(plain, want.fetchall()), key=repr)
    assert sorted((plain(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=repr) == expect
