"""Every query that has SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from arborfolio.plans.catalogue import QUERIES
from arborfolio.plans.oracles import ORACLES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 7) + 0.0
        return str(v)[:10] if hasattr(v, "isoformat") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(u == v or (isinstance(u, float) and abs(u - v) <= 2e-7 * max(1, abs(v))) for u, v in zip(x, y, strict=True))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "NetValue" in df.columns
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
