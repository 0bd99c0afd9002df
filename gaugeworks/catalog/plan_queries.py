"""Queries on the compositions, with column expressions in place of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..operators import conversations as convo_ops
from ..operators.scale import positions
from ..operators import comparison, exchange
from ..operators import judging as J
from ..plans import asking, interviews, judging, scoring, screening, synthesis
from .exposure_queries import _EX, _EXAMPLE, examples
from .judging_queries import boards
from .registry import query

# ---- search ------------------------------------------------------------------

_SEARCH = """
    base AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM {part}),
    cand AS (SELECT row_id, l_linenumber AS level, l_orderkey, l_suppkey, min(l_quantity) AS q, min(l_tax) AS t
             FROM base JOIN {lineitem} ON p_partkey = l_partkey GROUP BY ALL),
    ok AS (SELECT *, q > 48 AND t > 0.07 AS passed FROM cand WHERE l_orderkey % 9 > 0),
    firsts AS (SELECT row_id, min(level) AS level FROM ok WHERE passed GROUP BY 1),
    verified AS (SELECT o.row_id, o.level, o.l_orderkey, o.l_suppkey FROM ok o JOIN firsts f ON o.row_id = f.row_id AND o.level = f.level
                 WHERE passed QUALIFY row_number() OVER (PARTITION BY o.row_id ORDER BY l_orderkey, l_suppkey) = 1)
"""


def _search(t):
    base = positions(t.part.select("p_partkey"), [], [F.col("p_partkey")], synthesis.ROW)
    lines = t.lineitem.groupBy("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey").agg(
        F.min("l_quantity").alias("q"), F.min("l_tax").alias("t")
    )

    def generate(pending):
        made = pending.join(
            lines, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_linenumber") == F.col("time_savings").cast("int"))
        )
        return made.withColumn(
            "query", F.when(F.col("l_orderkey") % 9 > 0, F.concat(F.lit("q"), F.col("l_orderkey").cast("string")))
        )

    def performs(df, column):
        answer = F.when(F.col("q") > 48, "Yes").otherwise("No")
        return synthesis.passed(df.withColumn("perform", answer), "perform", "Yes", column)

    def realistic(df, column):
        return synthesis.passed(df.withColumn("real", F.when(F.col("t") > 0.07, "Yes")), "real", "Yes", column)

    return synthesis.search(
        base, [str(k) for k in range(1, 8)], generate, [performs, realistic], order=["l_orderkey", "l_suppkey"]
    )


@query("search_first_pass", "WITH " + _SEARCH + "SELECT row_id, level, l_orderkey, l_suppkey FROM verified")
def search_first_pass(t):
    verified, _, _ = _search(t)
    return verified.select(
        F.col(synthesis.ROW).alias("row_id"), F.col("time_savings").cast("int").alias("level"), "l_orderkey", "l_suppkey"
    )


@query("search_pending", "WITH " + _SEARCH + "SELECT row_id FROM base WHERE row_id NOT IN (SELECT row_id FROM verified)")
def search_pending(t):
    _, pending, _ = _search(t)
    return pending.select(F.col(synthesis.ROW).alias("row_id"))


@query("search_intermediate", "WITH " + _SEARCH + """
    SELECT o.level, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM ok o LEFT JOIN firsts f ON o.row_id = f.row_id
    WHERE f.level IS NULL OR o.level <= f.level GROUP BY 1""")
def search_intermediate(t):
    _, _, seen = _search(t)
    return seen.groupBy(F.col("time_savings").cast("int").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed_all").alias("n_passed")
    )


@query("search_input", """
    SELECT category_occ, category_task, row_number() OVER (ORDER BY category_occ, category_task) - 1 AS row_id FROM (
        SELECT DISTINCT p_brand AS category_occ, p_type AS category_task FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))""")
def search_input(t):
    tasks = t.part.select(F.col("p_brand").alias("category_occ"), F.col("p_type").alias("category_task"), F.lit("d").alias("task_detailed"))
    names = t.part.filter("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')").select(F.col("p_brand").alias("category_occ"))
    return synthesis.search_input(tasks, names).select("category_occ", "category_task", F.col(synthesis.ROW).alias("row_id"))


def _people_xml(prompt):
    def person(i):
        return F.concat(F.lit(f'<respondent id="{i}"><job_title>'), prompt, F.lit(f" {i}</job_title><years_experience>{i}</years_experience>"
                        f"<company_description>c{i}</company_description></respondent>"))

    notes = "".join(f'<respondent id="{i}"><summary>s{i}</summary></respondent>' for i in (1, 2))
    good = F.concat(F.lit("<responses><backgrounds>"), person(1), person(2), F.lit(f"</backgrounds><summaries>{notes}</summaries></responses>"))
    return F.when(~prompt.endswith("3"), good).otherwise(F.lit("sorry"))


@query("background_rows", """
    SELECT p_partkey, i AS respondent_pos, 'work of ' || p_brand || ' ' || (i % 2 + 1) AS job_title, i % 2 + 1 AS years_experience
    FROM {part}, (SELECT unnest([0, 1, 2]) AS i) WHERE p_brand NOT LIKE '%3'""")
def background_rows(t):
    """Two loops of two respondents, flattened in loop order, the first three kept."""
    bg = synthesis.generate_backgrounds(
        t.part.select("p_partkey", "p_brand"), "work of {p_brand}", asking.from_column(_people_xml), loops=2, first_k=3
    )
    return synthesis.explode_backgrounds(bg).select("p_partkey", "respondent_pos", "job_title", "years_experience")


@query("generated_queries", """
    SELECT p_partkey, 'mail ' || p_name AS email_subject, 'do ' || upper(p_brand) || ' as rewritten' AS query FROM {part} WHERE p_size % 4 > 0""")
def generated_queries(t):
    """Dialogue prompts with a rewritten turn, answered by an email."""
    turns = [("system", "sys"), ("user", "about {p_name} and {p_brand}"), ("assistant", "x"), ("user", "go {p_size}")]

    def answer(requests):
        # the rewrite prompt is a text, the dialogue is a conversation
        is_text = requests.schema["prompt"].dataType.simpleString() == "string"
        if is_text:
            out = F.concat(F.upper(F.element_at(F.split("prompt", " "), -1)), F.lit(" as rewritten"))
        else:
            size = F.element_at(F.split(F.get("prompt", F.lit(3))["content"], " "), -1).cast("int")
            name = F.regexp_extract(F.get("prompt", F.lit(1))["content"], "^about (.*) and ", 1)
            code = F.concat(F.lit("```\ndo "), F.get("prompt", F.lit(2))["content"], F.lit("\n```"))
            body = F.when(size % 4 > 0, code).otherwise(F.lit("no code"))
            out = F.concat(F.lit("<email><subject>mail "), name, F.lit("</subject><body>"), body, F.lit("</body></email>"))
        return requests.select("request_hash", out.alias("output"))

    made = synthesis.generate_queries(
        t.part.select("p_partkey", "p_name", "p_brand", "p_size"), turns, answer, rewrites=[(2, "rewrite after {user_turn}")]
    )
    return made.filter("query IS NOT NULL").select("p_partkey", "email_subject", "query")


@query("query_references", """
    SELECT p_partkey, p_name || chr(10) || chr(10) || '## Files' || chr(10) || 'text of ' || p_brand
           || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '## Notes' || chr(10) || 'big' ELSE '' END AS prompt FROM {part} WHERE p_size % 3 > 0
    UNION ALL SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '## Notes' || chr(10) || 'big' ELSE '' END FROM {part} WHERE p_size % 3 = 0""")
def query_references(t):
    """References for the rows with attachments, appended to the query."""
    rows = t.part.select(
        "p_partkey", F.col("p_name").alias("query"),
        F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("<attachment><filename>"), F.col("p_brand"), F.lit("</filename></attachment>"))).alias("attachments_raw_xml"),
        F.when(F.col("p_size") > 25, " big ").alias("notes"),
    )
    ask = asking.from_column(lambda p: F.concat(F.lit("<referenceOutput> text of "), F.regexp_extract(p, "<name>(.*?)</name>", 1), F.lit("</referenceOutput>")))
    made = synthesis.add_references(rows, "write {attachments_replaced_tags}", ask)
    text = synthesis.query_with_references("query", [("references_text", "Files"), ("notes", "Notes")])
    return made.select("p_partkey", text.alias("prompt"))


@query("checklists", """
    SELECT p_partkey, 2 AS n_items, 'about ' || p_name || '|short' AS items, model,
           round(CASE model WHEN 'm1' THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + 1 ELSE 1 END / 2.0, 6) AS score
    FROM {part}, (SELECT unnest(['m1', 'm2']) AS model)""")
def checklists(t):
    """Items from a first answer, then a score per model."""
    rows = t.part.select("p_partkey", F.col("p_name").alias("query"), "p_size")

    def ask(requests):
        if requests.schema["prompt"].dataType.simpleString() == "string":
            yes = F.when(F.col("prompt").contains("by m1 even"), "yes").otherwise("No")
            out = F.concat(F.lit("<item>"), yes, F.lit("</item><item>Yes</item>"))
        else:
            text = C.last_content("prompt")
            model = F.regexp_extract(C.first_of_role("prompt", "system"), "model: (.*)", 1)
            parity = F.when(F.regexp_extract(text, r"size (\d+)", 1).try_cast("int") % 2 == 0, " even").otherwise(" odd")
            items = F.concat(F.lit("<itemRequired>  about   "), F.regexp_extract(text, "items for (.*)", 1), F.lit("</itemRequired><itemRequired>short</itemRequired>"))
            out = F.when(text.startswith("items for"), items).otherwise(F.concat(F.lit("by "), F.coalesce(model, F.lit("")), parity))
        return requests.select("request_hash", out.alias("output"))

    made = synthesis.generate_checklists(rows, "first {query}", "items for {query}", ask)
    scored = synthesis.score_checklists(
        made, ["m1", "m2"], "solve {query} size {p_size}", "{answer}\n{checklist}", "<q {id}>{checklist_question}</q>", ask
    )
    return scored.select(
        "p_partkey", F.col("checklist_required_count").alias("n_items"),
        F.array_join("checklist_required_items", "|").alias("items"), "model", F.round("checklist_score", 6).alias("score"),
    )


# ---- interviews --------------------------------------------------------------

MESSAGES = [
    {"role": "user", "content": "You are {p_name}"},
    {"role": "assistant", "content": {"system": "first"}},
    {"role": "user", "content": "Size {p_size}?"},
    {"role": "assistant", "content": {"system": "second"}},
]


def _interview_model(requests):
    system = F.get("prompt", F.lit(0))["content"]
    flat = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit("="), m["content"])), ";")
    return requests.select("request_hash", F.concat(F.lit("<"), flat, F.lit(">"), F.lit("by "), system).alias("output"))


@query("interview_turns", """
    SELECT p_partkey, '<system=first;user=You are ' || p_name || '>by first' AS r1,
           '<system=second;user=You are ' || p_name || ';assistant=<system=first;user=You are ' || p_name || '>by first;user=Size ' || p_size || '?>by second' AS r3 FROM {part}""")
def interview_turns(t):
    """Two response turns, the second sees the first's result."""
    out = interviews.run_interview(t.part.select("p_partkey", "p_name", "p_size"), MESSAGES, _interview_model)
    return out.select("p_partkey", F.col("_result_1").alias("r1"), F.col("_result_3").alias("r3"))


@query("interview_labels", """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS score, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CAST(0 AS DOUBLE) END AS beta FROM {part}""")
def interview_labels(t):
    word = F.get(F.array(*[F.lit(x) for x in ("Yes", "no", "hm")]), F.col("p_size") % 3)
    rows = t.part.select("p_partkey", F.concat(F.lit("said "), word, F.lit(" \n\n\n\n")).alias("_result_1"))
    ask = asking.from_column(lambda p: F.concat(F.lit("<answer>"), F.regexp_extract(p, "said ([A-Za-z]+)", 1), F.lit("</answer>")))
    out = interviews.categorise_result(rows, "label: {result}", "_result_1", ask, taxonomy="interview_binary")
    return out.select("p_partkey", "score", "beta")


@query("score_with_retries", """
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE '25-49%' END AS score, CASE event_id % 4 WHEN 3 THEN 2 ELSE event_id % 4 END AS attempt,
           CASE event_id % 4 WHEN 3 THEN 'missing block' END AS parse_error, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(0.37 AS DOUBLE) END AS beta FROM {events}""")
def score_with_retries(t):
    """Rows become readable after none, one or two retries, or never."""
    block = (
        "<activity_task_matches><activity><activity_description>a</activity_description><belongs_to_task_being_scored>yes</belongs_to_task_being_scored>"
        "<reported_time_savings_minutes>30</reported_time_savings_minutes><original_time_minutes>2 hours</original_time_minutes></activity></activity_task_matches>"
    )
    need = F.col("event_id") % 4
    rows = t.events.select(
        "event_id", F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" needs "), need.cast("string")).alias("__base"),
        F.when(need == 0, F.lit(block)).otherwise(F.lit("unreadable")).alias("matches"),
    )

    def model(p):
        attempt = F.regexp_extract(p, r"attempt (\d+)", 1).cast("int")
        wanted = F.regexp_extract(p, r"needs (\d+)", 1).cast("int")
        return F.when(attempt >= wanted, F.lit(block)).otherwise(F.lit("unreadable"))

    out = interviews.score_with_retries(rows, asking.from_column(model), key="event_id", retries=2)
    return out.select("event_id", "score", F.col("attempt").cast("long").alias("attempt"), "parse_error", "beta")


# ---- screening and scoring ---------------------------------------------------


@query("categorisation", """
    WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM {turns} WHERE role = 'user'),
    s AS (SELECT conv_id, count(*) FILTER (i <> 1) AS n FROM u GROUP BY ALL)
    SELECT conv_id, CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS choice, 'n ' || n AS thinking, n % 3 < 2 AS pred_keep FROM s""")
def categorisation(t):
    """Request filter, summary and vote in a row, then the keep decision."""
    users = convo_ops.with_text_columns(convo_ops.from_turns(t.turns.filter("role = 'user'")))

    def model(p):
        heads = F.size(F.regexp_extract_all(p, F.lit("(?m)^(?:summarise: )?Human: "), F.lit(0)))
        count = F.regexp_extract(p, r"^classify: (\d+)", 1).try_cast("int")
        letter = F.when(count % 3 == 0, "a").when(count % 3 == 1, "B.").otherwise("d")
        return (
            F.when(p.startswith("drop:"), "<answer>1</answer>")
            .when(p.startswith("summarise:"), F.concat(F.lit("<answer>"), heads.cast("string"), F.lit("</answer>")))
            .otherwise(F.concat(F.lit("<thinking>n "), count.cast("string"), F.lit("</thinking><answer>"), letter, F.lit("</answer>")))
        )

    out = screening.categorise(
        users, "classify: {summ_instance_text}", asking.from_column(model),
        filter_template="drop: {numbered_instance_text_human_only}", summary_template="summarise: {instance_text_human_only}",
    )
    out = screening.categorisation_step(out, ["pred_choice"])
    return out.select("conv_id", F.col("pred_choice").alias("choice"), "thinking", "pred_keep")


@query("quality_step", """
    SELECT doc_id, NOT (coalesce(n_chars % 3 = 1, true) OR n_chars % 5 = 0) AS pred_keep FROM {documents}""")
def quality_step(t):
    """Two quality prompts of opposite polarity."""
    rows = t.documents.select("doc_id", F.concat_ws(" ", "n_chars", F.lit("chars")).alias("instance_text"))

    def model(p):
        n = F.regexp_extract(p, r"(\d+) chars", 1).cast("int")
        first = F.when(n % 3 == 1, "Yes").otherwise("no")
        second = F.when(n % 5 == 0, "No").when(n % 5 == 1, "yes").otherwise("unsure")
        return F.concat(F.lit("<answer> "), F.when(p.startswith("bad"), first).otherwise(second), F.lit("</answer>"))

    prompts = [("bad", "bad? {input_text}", True), ("good", "good? {input_text}", False)]
    return screening.quality_step(rows, prompts, asking.from_column(model)).select("doc_id", "pred_keep")


@query("homework_step", """
    SELECT doc_id, doc_id % 3 <> 0 AS pred_keep FROM {documents}""")
def homework_step(t):
    rows = t.documents.select("doc_id")
    model = asking.from_column(lambda p: F.when(F.regexp_extract(p, r"(\d+)", 1).cast("long") % 3 == 0, "<answer>YES</answer>").when(
        F.regexp_extract(p, r"(\d+)", 1).cast("long") % 3 == 1, "<answer>No</answer>"))
    return screening.homework_step(rows, "homework {doc_id}?", model).select("doc_id", "pred_keep")


@query("load_candidates", """
    WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, category_task, category_occ, dwa, rank_idx FROM {pairs} WHERE category_occ IN (SELECT p_brand FROM {part} WHERE p_size = 7)
               AND category_task IN (SELECT p_type FROM {part} WHERE p_retailprice > 950)),
    r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY category_task, category_occ, dwa ORDER BY rank_idx, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 3)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r JOIN {preds} USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE round_idx = 0 AND step = 's1' AND pred_keep""")
def load_candidates(t):
    """Two filters (both count), rank slice, survivors of one step."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    by_occ = t.part.filter("p_size = 7").select(F.col("p_brand").alias("category_occ"))
    by_task = t.part.filter("p_retailprice > 950").select(F.col("p_type").alias("category_task"))
    out = screening.load_candidates(
        t.pairs, filters=[by_occ, by_task], k_start=0, k_stop=3, preds=t.preds.filter("round_idx = 0"), steps=["s1"], keys=key
    )
    return out.select(*key)


@query("zero_shot_scores", """
    SELECT DISTINCT p_brand AS category_occ, p_type AS category_task, chr(CAST(65 + len(p_type) % 5 AS INTEGER)) AS label, CAST(len(p_type) % 5 AS DOUBLE) / 4 AS beta FROM {part}""")
def zero_shot_scores(t):
    tasks = t.part.select(F.col("p_brand").alias("category_occ"), F.col("p_type").alias("category_task"))

    def model(p):
        n = F.length(F.regexp_extract(p, "^task (.*) of ", 1)) % 5
        return F.concat(F.lit("<answer> "), F.lower(F.char(n + 65)), F.lit(" </answer>"))

    out = scoring.score_zero_shot(tasks, "task {task} of {occupation}", "new", asking.from_column(model))
    return out.select("category_occ", "category_task", "label", "beta")


@query("residual_scores", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS label,
           CASE p_size % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN -1 WHEN 2 THEN 0 END AS beta FROM {part}""")
def residual_scores(t):
    """Few-shot turns in front; D is outside the residual labels."""
    def ask(requests):
        n = F.regexp_extract(C.last_content("prompt"), r"(\d+)$", 1).cast("int") % 4
        ok = F.size("prompt") == 3
        return requests.select("request_hash", F.when(ok, F.concat(F.lit("<answer>"), F.char(n + 65), F.lit("</answer>"))).alias("output"))

    out = scoring.score_residual(
        t.part.select("p_partkey", "p_size"), [("user", "example"), ("assistant", "<answer>A</answer>")], "size {p_size}", ask
    )
    return out.select("p_partkey", "label", "beta")


@query("double_scores", """
    SELECT p_partkey, 'B' AS observed, CASE WHEN p_size % 2 = 0 THEN 'E' END AS perfect, CAST(0.25 AS DOUBLE) AS beta_observed, CASE WHEN p_size % 2 = 0 THEN CAST(1 AS DOUBLE) END AS beta_perfect FROM {part}""")
def double_scores(t):
    rows = t.part.select("p_partkey", F.concat(F.lit("size "), (F.col("p_size") % 2).cast("string")).alias("prompt"))
    model = asking.from_column(lambda p: F.concat(
        F.lit("<answer_observed>b</answer_observed>"), F.when(p.endswith("0"), "<answer_perfect>E</answer_perfect>").otherwise("")))
    return scoring.score_double(rows, model).drop("prompt")


@query("responses_per_model", """
    SELECT conv_id, model, model || ' after ' || n || ' turns' AS response FROM (SELECT conv_id, count(*) AS n FROM {turns} GROUP BY ALL),
        (SELECT unnest(['m1', 'm2']) AS model)""")
def responses_per_model(t):
    convos = convo_ops.from_turns(t.turns).withColumnRenamed("convo", "convo_subset")

    def ask(requests):
        model = F.regexp_extract(F.get("prompt", F.lit(0))["content"], "model: (.*)", 1)
        return requests.select("request_hash", F.concat(model, F.lit(" after "), (F.size("prompt") - 1).cast("string"), F.lit(" turns")).alias("output"))

    return interviews.responses_per_model(convos, ["m1", "m2"], ask).select("conv_id", "model", "response")


@query("embed_texts", """
    SELECT p_partkey, CAST(len(p_name) AS DOUBLE) AS x, CAST(p_partkey AS DOUBLE) * 0 + 1 AS y FROM {part}""")
def embed_texts(t):
    ask = asking.from_column(lambda p: F.concat(F.lit("["), F.length(p).cast("string"), F.lit(", 1.0]")))
    out = asking.embed_column(t.part.select("p_partkey", "p_name"), F.col("p_name"), "v", ask, model="e")
    return out.select("p_partkey", F.get("v", F.lit(0)).cast("double").alias("x"), F.get("v", F.lit(1)).cast("double").alias("y"))


@query("prompt_table", "WITH " + _EX + f""",
    mine AS (SELECT *, row_number() OVER (PARTITION BY category_occ, category_task ORDER BY md5('3|' || ex_id), ex_id) AS i FROM ex WHERE response IS NOT NULL),
    bt AS (SELECT category_occ, category_task, string_agg({_EXAMPLE}, chr(10) || chr(10) ORDER BY i) AS s FROM mine WHERE i <= 2 GROUP BY ALL)
    SELECT category_occ, category_task, 'task' AS method, category_task || ':' || chr(10) || s AS prompt FROM bt""")
def prompt_table(t):
    """Full prompt table from task examples; tasks without a prompt are dropped."""
    ex = examples(t)
    table = scoring.prompt_table(
        ex, ex, id_col="ex_id", prompt_ret="{task}:\n{examples_strs}", max_examples=2, seed=3, drop_missing=True
    )
    return table.select("category_occ", "category_task", "method", "prompt")


@query("predict_and_export", """
    WITH p AS (SELECT event_id, event_type, user_id % 60 AS category_idx FROM {events}),
    r AS (SELECT *, row_number() OVER (PARTITION BY category_idx ORDER BY md5('0|' || category_idx || '|' || event_id), event_id) AS i, count(*) OVER (PARTITION BY category_idx) AS n FROM p)
    SELECT event_id AS idx, category_idx, model, CASE WHEN model = 'm2' AND event_type = 'view' THEN 'Server error' ELSE model || ' on ' || event_type END AS response,
           CASE WHEN model = 'm2' AND event_type = 'view' THEN 'no response' END AS error
    FROM r, (SELECT unnest(['m1', 'm2']) AS model) WHERE i <= 5 AND n >= 5""")
def predict_and_export(t):
    """Sample, ask two models, join back with the hash check."""
    pairs = t.events.select(
        "event_id", (F.col("user_id") % 60).alias("category_idx"), F.array(C.turn("user", F.col("event_type"))).alias("convo_subset")
    )

    def ask(requests):
        model = F.regexp_extract(F.get("prompt", F.lit(0))["content"], "model: (.*)", 1)
        text = F.get("prompt", F.lit(1))["content"]
        out = F.when(~((model == "m2") & (text == "view")), F.concat(model, F.lit(" on "), text))
        return requests.select("request_hash", out.alias("output"))

    out = judging.predict(pairs, ["m1", "m2"], ask, n=5, idx="event_id")
    return out.select("idx", "category_idx", "model", "response", "error")


@query("judge_round", """
    WITH a AS (SELECT p_partkey AS uid, p_size % 3 AS s FROM {part})
    SELECT uid, model, CASE s WHEN 0 THEN 'A>B' WHEN 1 THEN 'A=B' END AS game1, CASE s WHEN 0 THEN 'B>A' WHEN 1 THEN 'A=B' END AS game2
    FROM a, (SELECT unnest(['m1', 'm2']) AS model)""")
def judge_round(t):
    """Answers judged in both orders; an unanswered judge call gives null games."""
    q = t.part.select(F.col("p_partkey").alias("uid"), F.lit("ei").alias("category"), F.array(C.turn("user", F.col("p_size").cast("string"))).alias("convo"))
    models = F.explode(F.array(*[F.lit(m) for m in ("m1", "m2", "base")]))
    answers = q.select("uid", models.alias("model"), "convo").select(
        "uid", "model", C.append_answer("convo", F.concat(F.lit("by "), F.col("model"))).alias("messages")
    )

    def ask(requests):
        text = F.get("prompt", F.lit(1))["content"]
        s = F.regexp_extract(text, "^(\\d+)", 1).cast("int") % 3
        base_first = text.contains("[A]by base")
        word = F.when(s == 0, F.when(base_first, "[[A>B]]").otherwise("[[B>A]]")).when(s == 1, "[[A=B]]")
        return requests.select("request_hash", word.alias("output"))

    games = judging.judge(
        q, answers, "base", ask, template="{QUESTION}[A]{ANSWER_A}[B]{ANSWER_B}", system={"ei": "be fair"}, judge_name="j", multi_turn=False
    )
    return J.game_scores(games).select("uid", "model", "game1", "game2")


@query("interview_scoring", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '75-100%' ELSE '0-24%' END AS score, CASE WHEN p_size % 2 = 0 THEN CAST(0.87 AS DOUBLE) ELSE CAST(0.12 AS DOUBLE) END AS beta FROM {part}""")
def interview_scoring(t):
    """Interview, activity matching with the task list, manual bucket."""
    rows = t.part.select("p_partkey", "p_name", "p_size", F.col("p_brand").alias("category_occ"), F.col("p_type").alias("category_task"))
    block = (
        "<activity_task_matches><activity><activity_description>a</activity_description><belongs_to_task_being_scored>yes</belongs_to_task_being_scored>"
        "<reported_time_savings_minutes>{}</reported_time_savings_minutes><original_time_minutes>1 hr</original_time_minutes></activity></activity_task_matches>"
    )

    def ask(requests):
        if requests.schema["prompt"].dataType.simpleString() != "string":
            text = F.concat(F.lit("size is "), F.regexp_extract(C.last_content("prompt"), "Size (\\d+)", 1))
        else:
            even = F.regexp_extract("prompt", "size is (\\d+)", 1).try_cast("int") % 2 == 0
            listed = F.col("prompt").startswith("- ")
            text = F.when(listed & even, F.lit(block.format("50 min"))).when(listed, F.lit(block.format("5 min")))
        return requests.select("request_hash", text.alias("output"))

    out = interviews.run_interview_scoring(
        rows, MESSAGES, ask, key="p_partkey", match_template="{occupation_tasks}\n{result}",
        tasks=rows, manual=True,
    )
    return out.select("p_partkey", "score", "beta")


@query("model_score_columns", """
    SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view,
           round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'error'), 6) AS error,
           round(avg(value) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'error')), 6) AS other FROM {events} GROUP BY 1""")
def model_score_columns(t):
    """Long results to one column per model."""
    known = ["click", "view", "purchase", "error"]
    model = F.when(F.col("event_type").isin(known), F.col("event_type")).otherwise("other")
    long = t.events.groupBy("user_id", model.alias("model")).agg(F.round(F.avg("value"), 6).alias("score"))
    users = t.events.select("user_id").distinct()
    return users.join(exchange.model_columns(long, ["user_id"], [*known, "other"], "score"), "user_id", "left")


@query("lb_valid_rows", """
    SELECT 'lb' || c_nationkey AS lb_id, c_mktsegment AS model, round(avg(c_acctbal), 2) AS score FROM {customer} GROUP BY c_nationkey, c_mktsegment HAVING count(*) % 13 > 0""")
def lb_valid_rows(t):
    """Rows with a model and a finite score, model and score first, NaN as NULL."""
    rows = boards(t).withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    out = comparison.valid_rows(comparison.nan_to_null(rows))
    return comparison.column_order(comparison.sort_rows(out, "score").select("lb_id", "score", "model"))


@query("summarised_requests", """
    SELECT doc_id, 'Human: about ' || source AS rendered FROM {documents}""")
def summarised_requests(t):
    """First request replaced by its summary."""
    rows = t.documents.select("doc_id", F.array(C.turn("user", F.concat(F.lit("from "), F.col("source")))).alias("convo_subset"))
    ask = asking.from_column(lambda p: F.concat(F.lit("<summary> about "), F.regexp_extract(p, "from (.*)!", 1), F.lit("</summary>")))
    return scoring.summarise(rows, "sum up {request}!", ask).select("doc_id", C.render("convo_subset").alias("rendered"))
