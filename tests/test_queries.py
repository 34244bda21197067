"""Every query of the registry runs on the smallest tables and equals its oracle."""

import os

import duckdb
import pandas as pd
import pytest

from evenloom import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value as text that doesn't depend on the engine's types."""
    if v is None or pd.isna(v):
        return ""
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v).removesuffix(" 00:00:00")


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, oracle, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:  # a plain version of it is in test_operators
        assert len(got)
        return
    want = oracle.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
