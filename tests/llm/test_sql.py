"""The queries that SQL can express, against it."""

import os

import duckdb
import pytest

from gleaner.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    need = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in need.description]
    rows = [{c: r[k] for k, c in enumerate(columns)} for r in need.fetchall()]
    got = [r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()]
    shown = lambda rows: sorted(str(sorted(r.items())) for r in rows)
    assert shown(got) == shown(rows) and len(got) >= 100  # as many as there are conversations
