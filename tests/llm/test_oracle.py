"""The queries with SQL twins equal them on the smallest tables."""

import os

import duckdb
import pytest

from tessel.llm.queries import ORACLE, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{D}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    want = c.execute(ORACLE[name]).fetchall()
    df = QUERIES[name](spark, D)
    columns = [x[0] for x in c.description]
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == sorted(want)
