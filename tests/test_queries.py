"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from repoweave import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)


def test_export_of_odd_titles_matches_its_sql(spark, tmp_path):
    titles = ("a token =", "= b", "=", "== = ==", "", " c = d ", "e", "=f=", "a == b")
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(i, f"http://x.org/{i}", f"<html><title>{t}</title><p>text</p></html>") for i, t in enumerate(titles)])
    c.sql(f"COPY pages TO '{tmp_path}/pages.parquet'")
    found = queries.queries()["html_export"](spark, str(tmp_path)).select("page", "position", "nav", "section").collect()
    assert sorted(map(tuple, found)) == sorted(c.sql(oracle.oracle_sql()["html_export"]).select("page", "position", "nav", "section").fetchall())


@pytest.mark.parametrize("name", ["page_scores", "report_rollup"])
def test_texts_are_read_once(spark, name):
    # what is planned after the texts were read once reads what that gave, not the documents
    assert "n_chars#" not in queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
