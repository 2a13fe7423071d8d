"""Queries on tables where results that take another rsID meet results that have it."""

import duckdb
import pytest

import __spark_entry__ as entry

from test_queries import DIR, rows


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Calls and ClinVar lines of rs7412 and rs429358 besides those of rs20 and rs40."""
    out, con = str(tmp_path_factory.mktemp("crowded")), duckdb.connect()
    kept = {
        "orders": "SELECT * REPLACE (CASE o_custkey WHEN 30 THEN 7412 WHEN 60 THEN 429358 WHEN 90 THEN 20 WHEN 120 THEN 40 ELSE o_custkey END AS o_custkey)",
        "part": "SELECT * REPLACE (CASE p_partkey WHEN 31 THEN 7413 WHEN 61 THEN 429359 ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey IN (21, 31, 41, 61) THEN 1 ELSE p_size END AS p_size)",
        "events": "SELECT *",
    }
    for name, of in kept.items():
        con.execute(f"COPY ({of} FROM '{DIR}/{name}.parquet') TO '{out}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return out, con


@pytest.mark.parametrize("name", ["explained", "merged_answers"])
def test_last_answer_of_two_results(spark, crowded, name):
    path, con = crowded
    shared = entry.queries()["explained"](spark, path).groupBy("sample_id", "rsid").count().filter("count > 1")
    assert shared.count() > 0
    assert rows(entry.queries()[name](spark, path).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())
