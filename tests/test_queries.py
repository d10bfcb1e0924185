"""Every query with a SQL counterpart, on both engines."""

import os

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, (list, dict)):
        return repr(x)
    if pd.isna(x):
        return None
    return bool(x) if isinstance(x, bool) else float(x) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)


def _rows(df):
    return sorted((tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_id", "rank", "cand_id", "sns"]
