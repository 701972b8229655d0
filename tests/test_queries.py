"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from gradewise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith("profit_sort_")) + ["profit_sort_chg30_asc", "profit_sort_updated_desc", "profit_sort_listings_asc"])
def test_same_rows(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [df.columns.index(c) for c in want.columns]
    got = [tuple(r[i] for i in at) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want.fetchall()), key=repr)
