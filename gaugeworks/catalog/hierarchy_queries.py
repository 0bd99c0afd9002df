"""Queries on the activity hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from .registry import query

_EDGES = "(SELECT title, task, dwa_title AS dwa FROM {task_dwa})"


def _edges(t):
    return t.task_dwa.select("title", "task", F.col("dwa_title").alias("dwa"))


@query("dwa_task_lists", f"""
    SELECT dwa, string_agg('- ' || task || ' (Occupation: ' || title || ')', chr(10) ORDER BY task, title) AS task_statements
    FROM {_EDGES} GROUP BY ALL""")
def dwa_task_lists(t):
    return H.dwa_task_lists(_edges(t))


@query("dwa_task_pages", f"""
    SELECT dwa, count(*) AS n_lines, bool_and(true) AS bounded FROM {_EDGES} GROUP BY ALL""")
def dwa_task_pages(t):
    """Lines of the lists: one row per DWA has them all."""
    lists = H.dwa_task_lists(_edges(t))
    n = F.size(F.split("task_statements", "\n"))
    return lists.groupBy("dwa").agg(F.sum(n).alias("n_lines"), (F.count(F.lit(1)) == 1).alias("bounded"))


_ADJ = f"""
    adj AS (SELECT DISTINCT a.dwa, b.dwa AS adjacent FROM {_EDGES} a JOIN {_EDGES} b
            ON a.title = b.title AND a.task = b.task AND a.dwa <> b.dwa)"""


@query("dwa_adjacent", "WITH " + _ADJ + " SELECT dwa, adjacent FROM adj")
def dwa_adjacent(t):
    return H.adjacent_dwas(_edges(t))


@query("dwa_adjacent_groups", f"""
    WITH g AS (SELECT title, task, count(DISTINCT dwa) AS n FROM {_EDGES} GROUP BY ALL)
    SELECT title, task, n AS n_members FROM g WHERE n > 5""")
def dwa_adjacent_groups(t):
    """Tasks with many DWAs and their number."""
    members = _edges(t).groupBy("title", "task").agg(F.count_distinct("dwa").alias("n_members"))
    return members.filter("n_members > 5")


@query("dwa_contrast_prompt", "WITH " + _ADJ + f"""
    SELECT d.dwa,
           coalesce(chr(10) || chr(10) || 'Not these:' || chr(10) || string_agg('- ' || adjacent, chr(10) ORDER BY adjacent) || chr(10) || 'end', '') AS does_not_include_prompt,
           CASE WHEN count(adjacent) = 0 THEN '' ELSE chr(10) || 'keep apart' END AS does_not_include_criteria
    FROM (SELECT DISTINCT dwa FROM {_EDGES}) d LEFT JOIN adj ON d.dwa = adj.dwa GROUP BY ALL""")
def dwa_contrast_prompt(t):
    return H.adjacent_contrast(_edges(t), prompt="Not these:\n{unrelated}\nend", criteria="keep apart")


@query("expand_descriptions", """
    SELECT e.title, e.task, e.dwa_title AS dwa, upper(e.dwa_title) AS dwa_detailed FROM {task_dwa} e""")
def expand_descriptions(t):
    described = t.supplier.select(
        F.col("s_name").alias("dwa"), F.upper("s_name").alias("dwa_detailed")
    )
    return H.expand_to_tasks(_edges(t), described)


@query("iwa_children", """
    SELECT iwa_title, string_agg('(' || i || ') ' || d, chr(10) ORDER BY i) AS children FROM (
        SELECT iwa_title, d, row_number() OVER (PARTITION BY iwa_title ORDER BY d) AS i FROM (
            SELECT DISTINCT iwa_title, 'about ' || e.dwa_title AS d FROM {task_dwa} e
            JOIN {dwa_iwa} i ON e.dwa_id = i.dwa_id AND e.dwa_title = i.dwa_title))
    GROUP BY ALL""")
def iwa_children(t):
    edges = t.task_dwa.withColumn("detail", F.concat(F.lit("about "), F.col("dwa_title")))
    return H.iwa_children(edges, t.dwa_iwa, keys=["dwa_id", "dwa_title"], detail="detail")


_SIB = """
    WITH d AS (SELECT DISTINCT title, task FROM {task_dwa})
    SELECT a.title, a.task, coalesce(string_agg(b.task, '|' ORDER BY b.task), '') AS others,
           coalesce(string_agg('- ' || b.task, chr(10) ORDER BY b.task), '- (no other tasks provided)') AS prompt_lines
    FROM d a LEFT JOIN d b ON a.title = b.title AND a.task <> b.task GROUP BY ALL"""


@query("sibling_tasks", _SIB)
def sibling_tasks(t):
    return H.sibling_tasks(t.task_dwa).select(
        "title", "task", F.array_join("others", "|").alias("others"),
        H.sibling_text(F.col("others")).alias("prompt_lines"),
    )


@query("task_contrast", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ' This does not include ' || lang || '. End.' END AS task_detailed FROM {documents}""")
def task_contrast(t):
    sentence = F.when(F.col("doc_id") % 3 == 0, F.lit("This does not include ")).otherwise(F.lit("It covers "))
    answer = F.concat(
        F.lit("<answer> Task\n "), sentence, F.col("lang"), F.lit(".\n End. </answer>")
    )
    answer = F.when(F.col("doc_id") % 3 == 2, F.lit("<answer>one line</answer>")).otherwise(answer)
    task = F.concat(F.lit(" "), F.col("source"), F.lit("\n"))
    return t.documents.select("doc_id", H.with_contrast(task, answer).alias("task_detailed"))


@query("description_map", """
    SELECT l_suppkey AS dwa, arg_min('order ' || l_orderkey || '/' || l_linenumber || '/' || l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS detailed
    FROM {lineitem} GROUP BY 1""")
def description_map(t):
    table = t.lineitem.select(
        F.col("l_suppkey").alias("dwa"), "l_orderkey", "l_linenumber", "l_partkey",
        F.concat_ws("/", F.concat(F.lit("order "), F.col("l_orderkey")), "l_linenumber", "l_partkey").alias("detailed"),
    )
    return H.description_map(table, "dwa", "detailed", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("attach_descriptions", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'D ' || s_name AS dwa_detailed, 'I ' || n_name AS iwa_detailed
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""")
def attach_descriptions(t):
    pairs = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    dwa = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("D "), "s_name").alias("dwa_detailed"))
    iwa = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("I "), "n_name").alias("iwa_detailed")
    )
    return H.attach_descriptions(pairs, [("l_suppkey", dwa), ("l_suppkey", iwa)])


@query("classified_dwas", """
    SELECT doc_id, output FROM {responses} WHERE output LIKE '%<answer>b</answer>%'""")
def classified_dwas(t):
    from ..functions import labels as L

    answered = t.responses.withColumn("answer", L.choice_tag("output", "answer", ["A", "B"]))
    return H.keep_classified(answered, "answer", "B").select("doc_id", "output")


@query("desired_dwas", """
    WITH touched AS (SELECT DISTINCT dwa_id FROM {task_dwa} WHERE (title, task) IN (
        SELECT 'occ ' || o_custkey, 'task ' || o_orderkey FROM {orders} WHERE o_totalprice > 499000))
    SELECT title, task, dwa_id FROM {task_dwa} WHERE dwa_id IN (SELECT dwa_id FROM touched)""")
def desired_dwas(t):
    wanted = t.orders.filter("o_totalprice > 499000").select(
        F.concat(F.lit("occ "), F.col("o_custkey").cast("string")).alias("title"),
        F.concat(F.lit("task "), F.col("o_orderkey").cast("string")).alias("task"),
    )
    return H.dwas_of_pairs(
        t.task_dwa, wanted, keys=["title", "task"], dwa="dwa_id"
    ).select("title", "task", "dwa_id")


@query("occupation_task_list", """
    SELECT title, string_agg('- ' || task, chr(10) ORDER BY task) AS occupation_tasks
    FROM (SELECT DISTINCT title, task FROM {task_dwa}) GROUP BY ALL""")
def occupation_task_list(t):
    return H.occupation_tasks(t.task_dwa, occ="title", task="task")


@query("occupation_subset_check", """
    SELECT DISTINCT o_custkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)""")
def occupation_subset_check(t):
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return H.missing_from(t.orders, known, ["o_custkey"])
