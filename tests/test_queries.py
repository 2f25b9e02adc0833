"""Each registered query of the graph engine against its SQL on DuckDB, at the smallest size: rows as a multiset."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from skein import catalog
from skein.plans import graph, relational, reports, stream, text  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert Counter(rows) == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
