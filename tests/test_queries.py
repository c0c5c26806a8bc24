"""Every core query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from tessella.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return str(value) if isinstance(value, datetime.date) else value


@pytest.fixture(scope="session")
def duck(tiny):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{tiny}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(SQL[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    order = [there.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() >= 0


def test_no_part_of_the_core_imports_the_subpackage():
    root = os.path.dirname(registry.__file__) + "/.."
    for folder, _, files in os.walk(root):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "tessella.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
