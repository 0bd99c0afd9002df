"""Registered queries: a Spark function and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import dealt_by_size, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Inputs:
    """The given tables and the tables derived from them by shared SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        tuned(spark)
        dealt_by_size(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        names = [n for n in (*TABLES, *DERIVED) if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs)`` under a name."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return register


def expand(text: str) -> str:
    """SQL with the derived tables it names as leading common table expressions."""
    used: list[str] = []

    def need(t: str) -> None:
        for n in DERIVED:
            if "{" + n + "}" in t and n not in used:
                need(DERIVED[n])
                used.append(n)

    need(text)
    plain = {n: n for n in (*TABLES, *DERIVED)}
    ctes = [f"{n} AS ({_fill(DERIVED[n], plain)})" for n in used]
    body = _fill(text, plain).strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(ctes)
    return head + (",\n" + body[4:].lstrip() if body[:5].upper() == "WITH " else "\n" + body)


def _fill(text: str, names: dict[str, str]) -> str:
    for n in names:
        text = text.replace("{" + n + "}", n)
    return text


# Derivations both engines run as they are.  Windows over unbounded groups are
# avoided, so the inputs themselves scale with the given tables.
DERIVED: dict[str, str] = {
    "turns": "SELECT conv_id, turn, role, text FROM {conversations} WHERE role <> 'system'",
    "corpus": "SELECT source AS dset_name, doc_id AS local_idx, text FROM {documents}",
    # a category is part type x brand x activity, the rank has gaps
    "pairs": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS category_task, p_brand AS category_occ,
               CONCAT('dwa ', CAST(l_suppkey AS VARCHAR(20))) AS dwa,
               l_orderkey AS instance_idx, CAST(FLOOR(l_extendedprice) AS BIGINT) * 3 AS rank_idx
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "preds": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS round_idx, 's0' AS step,
               MIN(l_quantity) > 10 AS pred_keep
        FROM {lineitem} WHERE l_tax > 0 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS round_idx, 's1' AS step,
               MIN(l_discount) < 0.08 AS pred_keep
        FROM {lineitem} WHERE l_tax > 0.01 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS round_idx, 's0' AS step,
               MIN(l_quantity) < 40 AS pred_keep
        FROM {lineitem} WHERE l_tax < 0.03 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    # an order is a task of its customer, a supplier is an activity
    "task_dwa": """
        SELECT DISTINCT CONCAT('occ ', CAST(o_custkey AS VARCHAR(20))) AS title,
               CONCAT('task ', CAST(o_orderkey AS VARCHAR(20))) AS task,
               l_suppkey AS dwa_id, s_name AS dwa_title
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "dwa_iwa": """
        SELECT s_suppkey AS dwa_id, s_name AS dwa_title, n_name AS iwa_title
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "judgments": """
        SELECT event_id, user_id AS uid, CONCAT('m', CAST(event_id % 7 AS VARCHAR(5))) AS model,
               CASE WHEN event_id % 97 = 0 THEN NULL
                    WHEN event_id % 5 = 0 THEN 'A>B' WHEN event_id % 5 = 1 THEN 'B>>A' WHEN event_id % 5 = 2 THEN 'A=B'
                    WHEN event_id % 5 = 3 THEN 'A>>B' ELSE 'B>A' END AS game1,
               CASE event_type WHEN 'click' THEN 'A>B' WHEN 'view' THEN 'A=B' WHEN 'purchase' THEN 'A>>B'
                    WHEN 'error' THEN 'B>>A' ELSE 'B>A' END AS game2,
               user_id % 10 AS subcategory_idx
        FROM {events}""",
    "responses": """
        SELECT d.doc_id, d.doc_id % 3 AS attempt, d.n_chars AS total_tokens, d.source AS model, d.text AS request_text,
               CASE WHEN l.quality IS NULL THEN 'no tags here'
                    WHEN l.quality = 1 THEN CONCAT('<thinking>ok</thinking> <answer> A. </answer> [[',
                         CASE WHEN l.toxic = 1 THEN 'B>A' ELSE 'A>>B' END, ']]')
                    ELSE '<answer>b</answer> [[A=B]] then [[B>>A]]' END AS output
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "durations": """
        SELECT event_id, user_id,
               CASE event_type WHEN 'click' THEN CONCAT(CAST(event_id % 90 AS VARCHAR(10)), ' minutes')
                    WHEN 'view' THEN CONCAT(CAST(event_id % 9 AS VARCHAR(10)), ' hrs')
                    WHEN 'purchase' THEN CONCAT('~', CAST(event_id % 20 AS VARCHAR(10)), '-', CAST(event_id % 20 + 10 AS VARCHAR(10)), ' min')
                    WHEN 'error' THEN 'NOT_SPECIFIED' ELSE CAST(event_id % 60 AS VARCHAR(10)) END AS raw_time
        FROM {events}""",
    "task_evidence": """
        SELECT c_mktsegment AS category_occ, CAST(c_custkey AS VARCHAR(20)) AS category_task,
               CASE WHEN c_acctbal > 5000 THEN 'evidence' END AS model_inputs
        FROM {customer}""",
}
