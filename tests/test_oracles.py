"""Every registered query against its SQL on the smallest tables; queries without SQL run and return rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from barloom.queries import ORACLE, QUERIES


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(t):
    """Rows as sorted text, columns by name, numbers to nine digits."""
    def show(v):
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    names = sorted(t.column_names)
    return names, sorted(tuple(map(show, r)) for r in zip(*[t.column(c).to_pylist() for c in names], strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toArrow()
    if name not in ORACLE:
        assert got.num_rows > 0
        return
    want = duck.execute(ORACLE[name]).to_arrow_table()
    assert plain(got)[0] == plain(want)[0]
    a, b = plain(got)[1], plain(want)[1]
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
    kinds = {f.name: str(f.type).replace("large_", "") for f in want.schema}
    assert {f.name: str(f.type).replace("large_", "") for f in got.schema} == kinds
