"""The registered queries: SQL parses, names agree, a few run end to end."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, table_hash  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_binds(con):
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}"), name


@pytest.mark.parametrize("name", ["convo_render", "label_mcq", "leaderboard_means", "coverage", "stratified_sample"])
def test_end_to_end(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert table_hash(df.columns, [tuple(r) for r in df.collect()])[0] == table_hash(columns, cur.fetchall())[0]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dwa", "category_idx", "instance_idx", "rank_idx", "sim", "subset"]
    assert df.count() > 0


@pytest.mark.parametrize("name,text", [
    ("semi_filter", "PushedFilters: [IsNotNull(p_size), LessThan(p_size,5)"),
    ("topk_restricted", "PushedFilters: [IsNotNull(label), LessThan(label,5)]"),
])
def test_filters_reach_the_scan(spark, name, text):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert text in plan


def test_no_cross_joins(spark):
    for name in ("topk_similarity", "grid_complete", "convo_text_dedupe_count", "range_lookup"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
