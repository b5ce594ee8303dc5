"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(normal(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(normal(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).orderBy("level").collect()
    assert rows[0].level == 0 and all(a.critical_ms <= b.critical_ms for a, b in zip(rows, rows[1:]))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_owned_paths_have_no_fallback(spark, tmp_path):
    """The SQL of join1_packages_for_paths asks for the fallback alone: no rows where every path has an owner, all owners where one has none."""
    for n, urls in enumerate((["http://a.com/x", "http://a.com/x/y"], ["http://a.com/x", "http://b.com/y"])):
        con = duckdb.connect()
        os.mkdir(f"{tmp_path}/{n}")
        con.execute(f"COPY (SELECT unnest(range({len(urls)})) AS page_id, unnest({urls}) AS url) TO '{tmp_path}/{n}/pages.parquet'")
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/{n}/pages.parquet'")
        got = catalog.QUERIES["join1_packages_for_paths"](spark, f"{tmp_path}/{n}").select("package", "everything").collect()
        assert sorted(tuple(r) for r in got) == sorted(con.execute(catalog.ORACLES["join1_packages_for_paths"]).fetchall())
        assert bool(got) == bool(n)
