"""Each query with SQL gives the rows that DuckDB gives for it, over the smallest tables."""

import os

import duckdb
import pandas
import pytest

from siftwell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    link = duckdb.connect()
    for name in TABLES:
        link.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return link


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: None if v is None or v is pandas.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted([tuple(show(v) for v in r) for r in frame.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, oracle, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(oracle.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
