"""Each query against its SQL, as the driver compares them, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from strandwise.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(db.execute(catalog.ORACLE_SQL[name]).fetchdf())
