"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from ragloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(frame):
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_search_runs(spark):
    found = catalog.QUERIES["rag_search"](spark, DATA).collect()
    assert 0 < len(found) <= 10
    assert len({r.doc_uri for r in found}) == len(found)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
