"""Every registered query with a SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w or all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1, abs(b))) for a, b in zip(g, w)), (g, w)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith(("op", "pipeline")):
            assert entry.queries()[name](spark, SF).count() > 0, name
