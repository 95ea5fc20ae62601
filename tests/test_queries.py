"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from loomspan.plans import catalogue, indexes, publishing, registry, reports  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return names, sorted(repr(tuple(map(plain, r))) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 8
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
