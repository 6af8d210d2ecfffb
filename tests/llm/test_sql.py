"""The operators' SQL on DuckDB against their queries, over whole small tables."""

import duckdb
import pytest

from gradewalk.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
