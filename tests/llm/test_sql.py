"""Every query of the subpackage that has a SQL twin, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from inkplane.llm import registry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    a = sorted(repr(tuple(r[c] for c in order)) for r in mine.collect())
    b = sorted(repr(r) for r in theirs.project(", ".join(f'"{c}"' for c in order)).fetchall())
    assert a == b
