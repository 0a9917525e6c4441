"""Queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from archive_lens.llm.queries import ORACLES, QUERIES

from .helpers import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = ", ".join(sorted(df.columns))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.execute(f"select {cols} from ({ORACLES[name]})").fetchall())
