"""Every catalog query against its SQL on the smallest tables; the others must run."""

import duckdb
import pandas as pd
import pytest

from uploadwatch.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.SQL:
        wanted = duck.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        left, right = rows(got.convert_dtypes()), rows(wanted.convert_dtypes())
        assert left == right
