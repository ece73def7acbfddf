"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from emberlog.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(DIR):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return None
    return repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)


def normal(df):
    df = df[sorted(df.columns)].map(plain)
    return sorted(map(tuple, df.itertuples(index=False)), key=str)


def test_all_have_sql():
    assert set(catalog.QUERIES) - catalog.FOLDS == set(catalog.ORACLE)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.FOLDS))
def test_fold_runs(spark, name):
    """Folds are compared with plain code in tests of their own; here they run over the tables."""
    assert catalog.QUERIES[name](spark, DIR).count() > 0
