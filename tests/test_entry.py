"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Loops of many small jobs; the larger check covers them.
SLOW = {"supplier_routes", "landmark_routes"}
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline" and n not in SLOW)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    clean = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted((tuple(round(float(v), 4) if isinstance(v, float) else v for v in r) for r in clean.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
