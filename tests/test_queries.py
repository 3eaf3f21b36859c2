"""Every query of the relational part against DuckDB."""

import math

import duckdb
import pytest

from sparkwarden import queries

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(([("nan" if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else str(x)) for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(want.fetchall())
