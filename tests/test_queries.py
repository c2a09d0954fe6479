"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from chronolane.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL; their operators are held against plain loops in test_operators, test_patterns and test_plain_loops.
TESTED = {
    "onset_match", "pack_batches", "train_plan", "eval_pool", "wide_patterns", "held_patterns", "wide_held_patterns", "found_patterns",
    "pattern_clusters", "pattern_distribution", "pattern_category", "pattern_card", "clean_steps",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.5g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:19].replace(" 00:00:00", "")
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows and name in TESTED
        return
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, rows) == rows_of(want.columns, want.fetchall())


def test_every_sql_has_its_query():
    assert not set(ORACLE_SQL) - set(QUERIES)
