"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from kinetable.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    f = float(v)
    return "nan" if math.isnan(f) else f


def rows_of(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    q = duck.sql(ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    want = [dict(zip(q.columns, r, strict=True)) for r in q.fetchall()]
    assert rows_of(got.collect(), columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
