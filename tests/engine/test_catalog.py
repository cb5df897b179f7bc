"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from dartline.plans import catalog


def norm(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    with duckdb.connect() as c:
        for f in os.listdir(sf):
            c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
        yield c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)
    assert len(got)
