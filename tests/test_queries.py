"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = {k: v for k, v in entry.queries().items() if k in entry.registry.QUERIES}
ORACLES = entry.oracle_sql()


def rows(df):
    text = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, sql, name):
    found = QUERIES[name](spark, folder).toPandas()
    if name in ORACLES:
        expected = sql.sql(ORACLES[name]).df()
        expected = expected.astype({c: "float64" for c in expected if str(expected[c].dtype).startswith("Int")})  # integers with nulls
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
