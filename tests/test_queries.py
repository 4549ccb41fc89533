"""Every query with SQL returns what DuckDB returns for it; the others return rows."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.catalog.oracle_sql()
#: Queries without SQL that fit models; a few stand for all in the quick suite.
ROWS = ["fit_linear", "fit_tree", "holt_winters", "vector_autoregression", "cleaned_table", "check_messages", "smote", "lda_projection"]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or v.__class__.__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = entry.catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    result = con.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    want = sorted(tuple(norm(r[found.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ROWS)
def test_returns_rows(spark, name):
    assert entry.catalog.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
