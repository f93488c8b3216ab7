"""Every core query against DuckDB on the smallest tables."""

import duckdb
import pytest

from lexispark.queries import ORACLE_SQL, QUERIES

TABLES = "part events documents labels pages benchmark".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
