"""Every query with SQL against DuckDB at the smallest scale; queries without are run."""

import duckdb
import pytest

from voxelmill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = [d[columns].sort_values(columns, ignore_index=True) for d in (got, want)]
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
