"""Every registered query of the catalogue against its SQL, on small rows of the given tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import decimal

    import numpy as np
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.generic,)):
        return plain(v.item())
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def names():
    from orbitweave.plans import catalogue

    return sorted(catalogue.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from orbitweave.plans import catalogue

    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got)
        return
    want = db.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    table = lambda f: sorted((tuple(plain(v) for v in r) for r in f[columns].itertuples(index=False, name=None)), key=repr)
    assert table(got) == table(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
