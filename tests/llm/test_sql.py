"""The operators that have SQL, on the smallest folder."""

import duckdb
import pytest
from test_entry import FOLDER, TABLES, _rows

from bitloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = registry.queries()[name](spark, FOLDER), con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    rows = [dict(zip(at, r)) for r in want.fetchall()]
    assert rows and sorted(got.columns) == sorted(at)
    assert _rows(sorted(at), [r.asDict() for r in got.collect()]) == _rows(sorted(at), rows)
