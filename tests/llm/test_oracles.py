"""Every text operator that has SQL, against it, over the smallest data folder."""

import duckdb
import pytest

from larkspur.llm import queries
from larkspur.session import TABLES


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operator_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in frame.collect()) == sorted(tuple(map(str, r)) for r in answer.fetchall())
