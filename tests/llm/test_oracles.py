"""The queries that SQL can express, against DuckDB over whole tables."""

import duckdb
import pytest

from sparkwarden.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
