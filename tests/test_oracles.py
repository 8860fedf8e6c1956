"""Every registered query with a SQL oracle, on the smallest driver tables."""

import math

import duckdb
import pytest

from checks import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_oracle(spark, data, duck, name):
    got = all_queries()[name](spark, data)
    want = duck.execute(all_oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = rows(got.columns, [tuple(r) for r in got.collect()])
    right = rows(columns, want.fetchall())
    assert len(left) == len(right) > 0
    assert all(close(x, y) for a, b in zip(left, right) for x, y in zip(a, b))
