"""Queries of this subpackage against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from chronolane.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    plain = lambda rows: sorted(([None if v is None else str(v) for v in r] for r in rows), key=str)
    assert plain(df.select(*order).collect()) == plain(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_each_has_sql_or_a_test_of_its_own():
    tested = {"op3_urls", "op4_fingerprints", "op6_mixing", "op7_toxicity", "op8_pii", "op9_decontamination", "op10_licenses"}
    assert set(QUERIES) == set(ORACLE_SQL) | tested
