"""The queries that SQL can express, against it, on the smallest tables."""

import duckdb
import pytest

from segmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    rel = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert got and sorted(names) == sorted(df.columns)
    assert got == sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall())
