"""Queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from gradeflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    text = lambda frame: sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))
    assert text(got) == text(want)
