"""Every query that SQL can express against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    have, asked = rows_of(got.columns, map(tuple, got.collect())), rows_of(want.columns, want.fetchall())
    assert len(have) == len(asked)
    assert have == asked
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: kinds[t] for c, t in got.dtypes if t in kinds} == {c: types[c] for c, t in got.dtypes if t in kinds}
