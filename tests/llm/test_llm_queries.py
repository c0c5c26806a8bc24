"""The pN_ queries on the smallest tables: columns, distinct rows, and SQL where there is some."""

import os

import duckdb
import pytest

from tessella.llm import queries, sql

QUERIES = queries.queries()
COLUMNS = {
    "p1_found": ["cluster_id", "field_name", "url"], "p3_found": ["url"], "p4_found": ["url", "lang"], "p5_found": ["url", "line_no"],
    "p6_found": ["url", "kw_id"], "p7_found": ["cluster_a", "cluster_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_rows_occur_once(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = [repr(r) for r in df.collect()]
    assert (rows or name == "p3_found") and len(rows) == len(set(rows))  # no page of the smallest table is residue
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    connection = duckdb.connect()
    for f in os.listdir(tiny):
        connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tiny}/{f}'")
    cursor = connection.execute(sql.oracle_sql()[name])
    there = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, tiny)
    assert sorted(map(tuple, df.select(*there).collect())) == sorted(cursor.fetchall())
