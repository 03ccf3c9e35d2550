"""Core queries against their SQL on the smallest test tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import evidence_queries, graph_queries, model_queries, rank_queries, skew_queries, split_queries

TABLES = Path("/root/testdata/sf0.001")
MODULES = [skew_queries, graph_queries, split_queries, rank_queries, evidence_queries, model_queries]
SLOW = {"khop_distances", "shortest_paths"}  # tests/test_whole_jobs.py has them against a search of its own
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def bag(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    for module in MODULES:
        assert set(module.QUERIES) <= set(queries)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLE if n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    sql = next(m.ORACLE[name] for m in MODULES if name in m.ORACLE)
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert bag(query(spark, str(TABLES)).toArrow()) == bag(duck.sql(sql).to_arrow_table())
