"""Every registered reference query against its SQL, over the smallest data folder."""

import duckdb
import pytest

from larkspur.plans import catalog
from larkspur.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(columns, names, rows):
    return sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    frame = catalog.QUERIES[name](spark, sf)
    answer = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    columns = sorted(names)
    assert rows_of(columns, frame.columns, frame.collect()) == rows_of(columns, names, answer.fetchall())
