"""The registered queries: stable schemas, and equal rows to their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

QUICK = ["p5_found", "wikilinks", "tags", "headings", "graph_edges", "tasks_parse", "registry_diff", "dense_topk", "debounce_batch", "resolve_exact", "bm25_topk"]


@pytest.fixture(scope="module")
def tables(sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(str([tidy(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    result = tables.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), result.columns)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p3_found", "p5_found"} <= set(queries)
    assert entry.entry is not None


def test_core_does_not_import_the_text_package():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(top, "vellumflow")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
