"""Every registered query against its DuckDB statement, on the smallest tables."""

import math
import os

import pytest

from tickloom.plans import all_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = sorted(n for n, (_, sql) in all_queries().items() if sql)
WITHOUT = sorted(n for n, (_, sql) in all_queries().items() if not sql)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    """Rows in an order of their own, columns by name, doubles to 6 digits."""

    def plain(x):
        if isinstance(x, float):
            return "none" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return "none" if x is None else str(x)

    names = sorted(table.column_names)
    return sorted(tuple(plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, duck, name):
    f, sql = all_queries()[name]
    got, want = f(spark, DATA).toArrow(), duck.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", WITHOUT)
def test_query_without_sql_runs(spark, name):
    assert all_queries()[name][0](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_r_multiples_of_an_entry_at_nothing(spark, duck, tmp_path):
    """Events with the value 0, as sf0.1 has: trades whose entry, and so whose stop, is 0."""
    duck.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 40 = 7 THEN 0.0 ELSE value END AS value) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'")
    f, sql = all_queries()["r_multiples"]
    want = rows(duck.sql(sql.replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).to_arrow_table())
    assert rows(f(spark, str(tmp_path)).toArrow()) == want and any("none" in r for r in want) and any("none" not in r for r in want)
