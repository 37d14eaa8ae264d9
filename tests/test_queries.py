"""Every core query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from caselode.plans import audit_plans, derived_plans, function_plans, markup_plans, media, queue_plans, registry, relational, search_plans, state, store_plans  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(df):
    for c in df.columns:
        if df[c].dtype.kind == "f" and (df[c].dropna() % 1 == 0).all():
            df[c] = df[c].astype("Int64")
        if df[c].dtype.kind == "O" and df[c].map(lambda x: type(x) is datetime.date).any():
            df[c] = pd.to_datetime(df[c])
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    none = {"nan", "NaT", "<NA>"}
    return sorted(tuple("None" if str(v) in none else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.SQL:
        assert len(got.columns)
        return
    want = con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)
