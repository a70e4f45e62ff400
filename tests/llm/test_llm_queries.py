"""Registered queries: names, entry point, SQL twins."""

import duckdb

import __spark_entry__
from pharmatext.llm.queries import QUERIES, SQL


def test_every_operator_has_a_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in SQL.items():
        found = QUERIES[name](spark, sf)
        wanted = con.execute(sql).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        plain = lambda rows: sorted(tuple(None if x is None else str(x) for x in r) for r in rows)
        got = plain(found.select(*wanted.columns).collect())
        assert got == plain(con.execute(sql).fetchall())
