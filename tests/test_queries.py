"""Every registered trace query against its SQL."""

import duckdb
import pytest
from conftest import DATA

from tracelake import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    expected = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.collect(), df.columns) == comparable(expected.fetchall(), columns)
