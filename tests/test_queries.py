"""Every query of the core against its SQL, on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from inkwell.plans import data_queries, index_queries, link_queries

MODULES = (index_queries, link_queries, data_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([row[i] for i in order] for row in rows), key=lambda r: [(x is None, round(x, 4) if isinstance(x, float) else x) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, found.fetchall())
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_recall_of_the_approximate_index(spark):
    assert QUERIES["ann_recall"](spark, "/root/testdata/sf0.01").head().recall >= 0.9


def test_union_and_resume_take_whole_tables(spark, data, con):
    names = QUERIES["union_names"](spark, data)
    tree, linked = link_queries._names(spark, data)
    assert names.count() == tree.count() + linked.count() > names.distinct().count()
    files = con.execute("SELECT count(DISTINCT file) FROM page").fetchone()[0]
    assert 0 < QUERIES["resume_open"](spark, data).select("file").distinct().count() < files


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["redirect_anti"](spark, data)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "IsNotNull(sha1)" in plan and schemas and not any("text" in s or "title" in s for s in schemas)
