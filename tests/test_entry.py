"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

from collections import Counter
from glob import glob
from os.path import basename

import duckdb
import pytest

import __spark_entry__ as entry
from skiffline.plans import archive_queries, collected_queries, core_queries

SF = "/root/testdata/sf0.001"
WITH_SQL = [*core_queries.SQL, *archive_queries.SQL, *collected_queries.SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        c.execute(f"create view {basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == Counter(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel_id", "msg_id", "content_hash"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
