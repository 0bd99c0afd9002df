"""Queries on examples, coverage, exposure and diverse picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..operators import diversity
from ..operators import exposure as E
from ..operators import hierarchy as H
from ..session import materialised
from .label_queries import _ACT, scored_activities
from .registry import query

# an order is a task of its customer, a line is an example with a response
_EX = """
    ex AS (SELECT 'occ ' || o_custkey AS category_occ, 'task ' || o_orderkey AS category_task, 'dwa ' || l_suppkey AS dwa,
                  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ex_id,
                  CASE WHEN l_tax > 0.01 THEN 'r' || l_partkey END AS response, l_tax
           FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_tax) AS l_tax
                 FROM {lineitem} GROUP BY ALL) JOIN {orders} ON l_orderkey = o_orderkey)"""


def examples(t):
    return _examples_of(_lines(t))


def _lines(t):
    """The lines of orders, dealt once for the grouping and the join."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_tax").alias("l_tax"))
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*lines.columns, "o_orderkey", "o_custkey")


def _examples_of(lines):
    ex_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(
        F.concat(F.lit("occ "), F.col("o_custkey").cast("string")).alias("category_occ"),
        F.concat(F.lit("task "), F.col("o_orderkey").cast("string")).alias("category_task"),
        F.concat(F.lit("dwa "), F.col("l_suppkey").cast("string")).alias("dwa"),
        ex_id.alias("ex_id"),
        F.when(F.col("l_tax") > 0.01, F.concat(F.lit("r"), F.col("l_partkey").cast("string"))).alias("response"),
        F.array(C.turn("user", F.concat(F.lit("q "), ex_id))).alias("convo_subset"),
        "l_tax",
    )


def _flat(col):
    return F.array_join(
        F.transform(col, lambda e: F.concat(C.last_content(e["input"]), F.lit("="), e["output"])), ","
    )


@query("task_examples", "WITH " + _EX + """
    SELECT category_occ, category_task, string_agg('q ' || ex_id || '=' || response, ',' ORDER BY ex_id) AS examples
    FROM ex WHERE response IS NOT NULL GROUP BY ALL""")
def task_examples(t):
    out = E.task_examples(examples(t), order=["ex_id"])
    return out.select(*E.TASK, _flat("examples").alias("examples"))


@query("sampled_examples", "WITH " + _EX + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY category_occ ORDER BY md5('0|' || ex_id), ex_id) AS i FROM ex WHERE response IS NOT NULL)
    SELECT category_occ, string_agg('q ' || ex_id || '=' || response, ',' ORDER BY i) AS examples FROM r WHERE i <= 3 GROUP BY ALL""")
def sampled_examples(t):
    out = E.sampled_examples(examples(t), id_col="ex_id", n=3, keys=["category_occ"])
    return out.select("category_occ", _flat("examples").alias("examples"))


_BY_DWA = """,
    edges AS (SELECT DISTINCT category_occ, category_task, dwa FROM ex),
    linked AS (SELECT e.category_occ, e.category_task, x.ex_id, x.response, e.dwa FROM edges e JOIN ex x ON e.dwa = x.dwa WHERE response IS NOT NULL)"""


@query("examples_by_dwa", "WITH " + _EX + _BY_DWA + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY category_occ, category_task ORDER BY md5('0|' || ex_id), ex_id, dwa) AS i FROM linked)
    SELECT category_occ, category_task, string_agg('q ' || ex_id || '=' || response, ',' ORDER BY i) AS examples FROM r WHERE i <= 2 GROUP BY ALL""")
def examples_by_dwa(t):
    # read several times: the narrow rows are written once
    ex = _examples_of(materialised(_lines(t)))
    out = E.sampled_examples_by_dwa(ex, ex, id_col="ex_id", n=2)
    return out.select(*E.TASK, _flat("examples").alias("examples"))


@query("flatten_by_dwa", "WITH " + _EX + _BY_DWA + """
    SELECT category_occ, category_task, count(*) AS n_examples FROM linked GROUP BY ALL""")
def flatten_by_dwa(t):
    ex = examples(t)
    return E.dwa_example_counts(ex, ex)


_EXAMPLE = "'### Example' || chr(10) || '```' || chr(10) || 'Human: q ' || ex_id || chr(10) || chr(10) || 'LLM: ' || response || chr(10) || '```'"


@query("retrieval_fallback", "WITH " + _EX + f""",
    space AS (SELECT DISTINCT category_occ, category_task, dwa FROM ex),
    found AS (SELECT * REPLACE (CASE WHEN l_tax > 0.07 THEN response END AS response) FROM ex),
    mine AS (SELECT *, row_number() OVER (PARTITION BY category_occ, category_task ORDER BY md5('0|' || ex_id), ex_id) AS i
             FROM found WHERE response IS NOT NULL),
    bt AS (SELECT category_occ, category_task, string_agg({_EXAMPLE}, chr(10) || chr(10) ORDER BY i) AS s FROM mine WHERE i <= 2 GROUP BY ALL),
    linked AS (SELECT e.category_occ, e.category_task, e.dwa, x.ex_id, x.response FROM space e JOIN found x ON e.dwa = x.dwa
               JOIN {{supplier}} ON e.dwa = 'dwa ' || s_suppkey WHERE response IS NOT NULL AND s_acctbal > 0),
    ld AS (SELECT *, row_number() OVER (PARTITION BY category_occ, category_task ORDER BY md5('0|' || ex_id), ex_id, dwa) AS i FROM linked),
    bd AS (SELECT category_occ, category_task, string_agg({_EXAMPLE}, chr(10) || chr(10) ORDER BY i) AS s FROM ld WHERE i <= 2 GROUP BY ALL)
    SELECT k.category_occ, k.category_task, CASE WHEN bt.s IS NOT NULL THEN 'task' WHEN bd.s IS NOT NULL THEN 'dwa' ELSE 'zs' END AS method,
           CASE WHEN coalesce(bt.s, bd.s) IS NOT NULL THEN k.category_task || ' / ' || k.category_occ || ':' || chr(10) || coalesce(bt.s, bd.s)
                ELSE k.category_task || ' for ' || k.category_occ END AS prompt
    FROM (SELECT DISTINCT category_occ, category_task FROM space) k
    LEFT JOIN bt USING (category_occ, category_task) LEFT JOIN bd USING (category_occ, category_task)""")
def retrieval_fallback(t):
    """Prompt per task: own examples, else those of its activities, else zero-shot."""
    ex = _examples_of(materialised(_lines(t)))
    # few answers, and activities that only some suppliers are classified for
    found = ex.withColumn("response", F.when(F.col("l_tax") > 0.07, F.col("response")))
    classified = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("dwa "), F.col("s_suppkey").cast("string")).alias("dwa"))
    by_task = E.sampled_examples(found, id_col="ex_id", n=2)
    by_dwa = E.sampled_examples_by_dwa(found, ex.join(classified, "dwa"), id_col="ex_id", n=2)
    table = E.retrieval_table(ex, by_task, by_dwa)
    out = E.prompt_with_fallback(
        table, prompt_ret="{task} / {occupation}:\n{examples_strs}", prompt_zs="{task} for {occupation}"
    )
    return out.select(*E.TASK, "method", "prompt")


@query("examples_tagged", "WITH " + _EX + """
    SELECT category_occ, category_task, string_agg('### Example' || chr(10) || '```' || chr(10) || '<human>' || chr(10) || 'q ' || ex_id || chr(10) || '</human>' || chr(10) || chr(10)
           || '<LLM>' || chr(10) || response || chr(10) || '</LLM>' || chr(10) || '```', chr(10) || chr(10) ORDER BY ex_id) AS examples
    FROM ex WHERE response IS NOT NULL GROUP BY ALL""")
def examples_tagged(t):
    out = E.task_examples(examples(t), order=["ex_id"])
    return out.select(*E.TASK, C.examples_text("examples", style="tagged").alias("examples"))


_COV = """
    SELECT category_occ, category_task, round(avg(CASE WHEN model_inputs IS NOT NULL THEN 1.0 ELSE 0.0 END) OVER w, 6) AS coverage,
           CAST(sum(CASE WHEN model_inputs IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_covered, count(*) OVER w AS n_tasks
    FROM {task_evidence} WINDOW w AS (PARTITION BY category_occ)"""


@query("coverage", _COV)
def coverage(t):
    out = E.add_coverage(t.task_evidence)
    return out.select(*E.TASK, F.round("coverage", 6).alias("coverage"), "n_covered", "n_tasks")


@query("coverage_filter", f"SELECT category_occ, category_task, n_covered FROM ({_COV}) WHERE coverage >= 0.45")
def coverage_filter(t):
    return E.filter_by_coverage(E.add_coverage(t.task_evidence), 0.45).select(*E.TASK, "n_covered")


@query("occupation_exposure", _ACT + """
    SELECT user_id, round(avg(CASE span WHEN '0-24%' THEN 0.12 WHEN '25-49%' THEN 0.37 WHEN '50-74%' THEN 0.62 ELSE 0.87 END), 6) AS exposure,
           round(avg(n_unmatched), 6) AS mean_unmatched
    FROM s WHERE event_id % 7 > 0 OR user_id % 2 = 0 GROUP BY user_id HAVING bool_and(span IS NOT NULL)""")
def occupation_exposure(t):
    scored = scored_activities(t).filter("event_id % 7 > 0 OR user_id % 2 = 0").withColumn(
        "beta", L.score("span", "interview_span")
    )
    out = E.occupation_exposure(scored, occ="user_id", score="span", beta="beta", unmatched="n_unmatched")
    return out.select("user_id", F.round("exposure", 6).alias("exposure"), F.round("mean_unmatched", 6).alias("mean_unmatched"))


@query("residual_labels", """
    WITH ref AS (SELECT p_brand, p_type, arg_min('E' || p_partkey % 5, p_partkey) AS l FROM {part} WHERE p_size < 20 GROUP BY ALL)
    SELECT p.p_partkey, CASE l WHEN 'E0' THEN 'E0' WHEN 'E1' THEN 'E2' WHEN 'E2' THEN 'E1' END AS reference_label
    FROM {part} p JOIN ref USING (p_brand, p_type)
    WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM {part} WHERE p_size > 30) AND l IN ('E0', 'E1', 'E2')""")
def residual_labels(t):
    part = t.part.withColumnsRenamed({"p_brand": "category_occ", "p_type": "category_task"})
    ref = part.filter("p_size < 20").withColumn(
        "reference_label", F.concat(F.lit("E"), (F.col("p_partkey") % 5).cast("string"))
    )
    out = E.residual_input(part, part.filter("p_size > 30"), ref, order=["p_partkey"])
    return out.select("p_partkey", "reference_label")


@query("score_count_pivot", """
    WITH s AS (SELECT CASE WHEN label IS NULL THEN 'None' ELSE label END AS score, model FROM (
        SELECT 'm' || doc_id % 3 AS model, CASE WHEN output LIKE '%<answer>b</answer>%' THEN '0.5' WHEN output LIKE '% A. %' THEN '1.0' END AS label FROM {responses}))
    SELECT score, count(*) FILTER (model = 'm0') AS m0, count(*) FILTER (model = 'm1') AS m1, count(*) FILTER (model = 'm2') AS m2 FROM s GROUP BY ALL""")
def score_count_pivot(t):
    label = L.lookup(L.mcq("output"), {"A": 1.0, "B": 0.5}).cast("double")
    rows = t.responses.select(label.alias("beta"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("m"))
    return E.score_count_pivot(rows, "beta", "m", ["m0", "m1", "m2"])


@query("scores_listing", """
    SELECT DISTINCT p_brand AS category_occ, p_type AS category_task, CAST(p_size AS DOUBLE) / 50 AS beta FROM {part}""")
def scores_listing(t):
    rows = t.part.select(
        F.col("p_brand").alias("category_occ"), F.col("p_type").alias("category_task"),
        (F.col("p_size").cast("double") / 50).alias("beta"),
    )
    return E.scores_listing(rows)


@query("task_details", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'about ' || p_name || ' of ' || p_brand AS task_detailed
    FROM {lineitem} LEFT JOIN {part} ON l_partkey = p_partkey""")
def task_details(t):
    """Attach a detail text by key with the m:1 check."""
    details = t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("about "), F.col("p_name"), F.lit(" of "), F.col("p_brand")).alias("task_detailed"),
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return H.join_m1(rows, details, ["l_partkey"])


@query("request_summaries", """
    WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u FROM {turns} GROUP BY ALL)
    SELECT conv_id, 'Human: ' || trim(substr(u, 1, 20)) AS rendered FROM f""")
def request_summaries(t):
    from ..operators import conversations as ops

    convos = ops.from_turns(t.turns).withColumnRenamed("convo", "convo_subset")
    prompt = E.summary_requests(convos, "<summary>{request}</summary>")
    short = F.trim(F.substring(F.regexp_extract(prompt, r"(?s)<summary>(.*)</summary>", 1), 1, 20))
    return E.with_summary(convos.withColumn("request_summary", short)).select(
        "conv_id", C.render("convo_subset").alias("rendered")
    )


def _diverse_sql(k: int, rows: str, group: list[str], key: str, *, within: bool = False) -> str:
    """TF-IDF, all distances within a group and the greedy picks, step by step."""
    cols = ", ".join(group)

    def of(alias):
        return ", ".join(f"{alias}.{g}" for g in group)

    def same(x, y):
        return " AND ".join(f"{x}.{g} = {y}.{g}" for g in group)

    picks = [f"p0 AS (SELECT {cols}, {key}, 0 AS pick FROM means QUALIFY row_number() OVER (PARTITION BY {cols} ORDER BY m DESC, {key}) = 1)"]
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(i))
        picks.append(f"""
    p{i} AS (SELECT {of("g")}, d.a AS {key}, {i} AS pick FROM dist d JOIN ({before}) b ON d.b = b.{key} JOIN grp g ON d.a = g.{key}
         WHERE d.a NOT IN (SELECT {key} FROM ({before})) GROUP BY {of("g")}, d.a
         QUALIFY row_number() OVER (PARTITION BY {of("g")} ORDER BY min(d.d) DESC, d.a) = 1)""")
    union = " UNION ALL ".join(f"SELECT {cols}, {key}, pick FROM p{j}" for j in range(k))
    scope = f"{cols}, " if within else ""
    total = "c" if within else "(SELECT count(*) FROM src)"
    return f"""
    WITH src AS MATERIALIZED ({rows}),""" + r"""
    w AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}') AS t FROM src),""" + f"""
    grams AS (SELECT {key}, {cols}, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS g FROM w),
    tf AS MATERIALIZED (SELECT {key}, {cols}, g, count(*) AS tf FROM grams GROUP BY ALL),
    df AS (SELECT {scope}g, count(*) AS df FROM tf GROUP BY ALL),
    grp AS MATERIALIZED (SELECT {key}, {cols}, count(*) OVER (PARTITION BY {cols}) AS c FROM src),
    wt AS MATERIALIZED (SELECT {key}, g, tf * (ln((1.0 + {total}) / (1 + df)) + 1) AS w FROM tf JOIN df USING ({scope}g) JOIN (SELECT {key}, c FROM grp) USING ({key})),
    nm AS (SELECT {key}, sqrt(sum(w * w)) AS nn FROM wt GROUP BY ALL),
    v AS MATERIALIZED (SELECT {key}, {cols}, g, w / nn AS w FROM wt JOIN nm USING ({key}) JOIN grp USING ({key}) WHERE c > {k}),
    sim AS MATERIALIZED (SELECT a.{key} AS a, b.{key} AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.g = b.g AND {same("a", "b")} GROUP BY ALL),
    pairs_ AS MATERIALIZED (SELECT x.{key} AS a, y.{key} AS b, {of("x")}, x.c, coalesce(s, 0) AS s FROM grp x JOIN grp y ON {same("x", "y")}
               LEFT JOIN sim ON sim.a = x.{key} AND sim.b = y.{key} WHERE x.c > {k}),
    dist AS MATERIALIZED (SELECT a, b, round(1 - s, 9) AS d FROM pairs_ WHERE a <> b),
    means AS (SELECT a AS {key}, {cols}, round(1 - sum(s) / any_value(c), 9) AS m FROM pairs_ GROUP BY ALL),
    """ + ",".join(picks) + f"""
    SELECT {cols}, {key}, CAST(NULL AS INTEGER) AS pick FROM grp WHERE c <= {k} UNION ALL {union}"""


@query("diverse_examples", _diverse_sql(5, "SELECT doc_id, source, lang, text FROM {documents}", ["source", "lang"], "doc_id"))
def diverse_examples(t):
    """Five far-apart documents per source and language."""
    docs = t.documents.select("doc_id", "source", "lang", "text")
    return diversity.diverse_rows(docs, ["source", "lang"], "doc_id", "text", 5).select(
        "source", "lang", "doc_id", "pick"
    )


@query("diverse_list_items", _diverse_sql(
    2, "SELECT conv_id, conv_id * 100000 + turn AS item, text FROM {turns}", ["conv_id"], "item", within=True))
def diverse_list_items(t):
    """Two far-apart turns per conversation, weighted within the conversation."""
    items = t.turns.select(
        "conv_id", (F.col("conv_id") * 100_000 + F.col("turn")).alias("item"), "text"
    )
    return diversity.diverse_rows(items, ["conv_id"], "item", "text", 2, fit="group").select(
        "conv_id", "item", "pick"
    )
