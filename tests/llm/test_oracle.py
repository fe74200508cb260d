"""The queries that SQL can express, side by side with DuckDB."""

import duckdb
import pytest

from strandlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(found.description) == len(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
