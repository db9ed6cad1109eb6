"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from plumbline.plans import load
from plumbline.plans.registry import ORACLES, QUERIES

load()
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        value = value.tolist()
    if not isinstance(value, (list, tuple)) and pd.isna(value):
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert rows(mine) == rows(theirs)
    assert len(mine) > 0 or name == "deleted_paths"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
