"""Every registered query against its SQL in DuckDB."""

import hashlib
import math
import os

import duckdb
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_matches_sql(spark, sf, duck, name):
    out = catalog.QUERIES[name](spark, sf)
    names = sorted(out.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in out.collect())
    cursor = duck.execute(catalog.SQL[name])
    theirs_names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    assert sorted(theirs_names) == names
    assert mine == sorted(tuple(plain(dict(zip(theirs_names, r, strict=True))[c]) for c in names) for r in rows)


@pytest.fixture(scope="module")
def late_spread(spark, tmp_path_factory):
    """Orders whose price is one number but for the rows of largest hash, which no sample of 5,000 reaches."""
    place = {k: n for n, k in enumerate(sorted(range(8000), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()))}
    rows = [(k, k % 50, "FOP"[k % 3], 1000.0 if place[k] < 6500 else 1000.0 + k, f"{k % 5}-P") for k in range(8000)]
    folder = tmp_path_factory.mktemp("late")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


ALL_ROWS = {
    "redundancy_gate": [("price", "POST_EVAL_REDUNDANT"), ("signed", "POST_EVAL_REDUNDANT")],
    "redundancy_max": [("price", 1.0, "signed", False), ("signed", 1.0, "flipped", False)],
    "select_nonredundant": [("flipped",), ("price",), ("small",)],
}


@pytest.mark.parametrize("name", list(ALL_ROWS))
def test_similarities_are_over_all_rows(spark, late_spread, name):
    assert sorted(map(tuple, catalog.QUERIES[name](spark, late_spread).collect())) == ALL_ROWS[name]
    with duckdb.connect() as c:
        c.execute(f"create view orders as select * from read_parquet('{late_spread}/orders.parquet/*.parquet')")
        assert sorted(c.execute(catalog.SQL[name]).fetchall()) == ALL_ROWS[name]
