"""Every query of the engine against its SQL."""

import os

import duckdb
import pytest

from gleaner.plans import oracle
from gleaner.plans import queries as plans


def canonical(rows, columns):
    def one(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(str(one(r[c])) for c in columns) for r in rows))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    need = duck.execute(oracle.SQL[name])
    columns = sorted(d[0] for d in need.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in need.description]
    rows = [dict(zip(names, r)) for r in need.fetchall()]
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical(rows, columns)
