"""Round trips: a derived table is written by a sink and read by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..operators import conversations as convo_ops
from ..operators import exchange
from ..operators import judging as J
from ..operators import predictions as P
from ..plans import leaderboards
from ..session import checkpoint_folder
from ..sources import readers as R
from ..sources import sinks as W
from .registry import query

_NL2 = "chr(10) || chr(10)"
_TEXT = f"string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn)"


def _place(t) -> str:
    """A new folder where all executors see it."""
    return f"{checkpoint_folder(t.spark)}/roundtrip-{uuid.uuid4().hex}"


def _written(t, df):
    place = _place(t)
    df.write.parquet(place)
    return t.spark.read.parquet(place)


def _convos(t):
    return convo_ops.from_turns(t.turns)


def _rendered(df):
    return df.select("dset_name", "local_idx", C.render("convo").alias("text"))


# ---- corpora -----------------------------------------------------------------


@query("source_sided", f"""
    SELECT 'pairs' AS dset_name, conv_id AS local_idx, coalesce({_TEXT} FILTER (role = 'user'), '') AS text FROM {{turns}} GROUP BY conv_id""")
def source_sided(t):
    """Side B of a corpus with two conversation columns."""
    both = _convos(t).select(
        F.col("conv_id").alias("local_idx"), F.col("convo").alias("conversation_a"), C.of_role("convo", "user").alias("conversation_b")
    )
    return _rendered(R.sided_corpus(_written(t, both), "pairs", use_a=False))


@query("source_two_columns", f"SELECT 'wide' AS dset_name, conv_id AS local_idx, {_TEXT} AS text FROM {{turns}} GROUP BY conv_id")
def source_two_columns(t):
    """Side A of a wide corpus; the other columns are not read."""
    wide = _convos(t).select(
        F.col("conv_id").alias("local_idx"), F.col("convo").alias("conversation_a"), F.col("convo").alias("conversation_b"),
        F.lit("x").alias("winner"), F.lit(1).alias("n"),
    )
    return _rendered(R.sided_corpus(_written(t, wide), "wide"))


@query("source_single", f"SELECT 'one' AS dset_name, conv_id AS local_idx, {_TEXT} AS text FROM {{turns}} GROUP BY conv_id")
def source_single(t):
    rows = _convos(t).select(F.col("conv_id").alias("local_idx"), F.col("convo").alias("conversation"))
    return _rendered(R.single_corpus(_written(t, rows), "one"))


@query("source_numbered", """
    SELECT 'new' AS dset_name, count(DISTINCT conv_id) AS n, CAST(0 AS BIGINT) AS first, count(DISTINCT conv_id) - 1 AS last, count(DISTINCT conv_id) AS n_distinct FROM {turns}""")
def source_numbered(t):
    """A corpus without an index is numbered from 0 without gaps."""
    rows = _written(t, _convos(t).select(F.col("convo").alias("conversation")).repartition(5))
    return R.single_corpus(rows, "new").groupBy("dset_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("local_idx").alias("first"), F.max("local_idx").alias("last"),
        F.count_distinct("local_idx").alias("n_distinct"),
    )


@query("source_collection", """
    SELECT DISTINCT CASE conv_id % 3 WHEN 0 THEN 'arena_55k' ELSE 'wildchat' END AS dset_name, conv_id AS local_idx FROM {turns} WHERE conv_id % 3 < 2""")
def source_collection(t):
    """A named collection reads its datasets only."""
    place = _place(t)
    name = F.when(F.col("conv_id") % 3 == 0, "arena_55k").when(F.col("conv_id") % 3 == 1, "wildchat").otherwise("elsewhere")
    _convos(t).select(name.alias("dset_name"), F.col("conv_id").alias("local_idx"), "convo").write.partitionBy("dset_name").parquet(place)
    return R.corpora(t.spark, place, "chat_v1").select("dset_name", "local_idx")


@query("source_strings", f"""
    SELECT conv_id AS local_idx, coalesce(string_agg('Human: ' || text, {_NL2} ORDER BY turn) FILTER (role = 'user'), '') AS text FROM {{turns}} GROUP BY conv_id""")
def source_strings(t):
    """Conversations as texts of a chosen form."""
    rows = _convos(t).select(F.col("conv_id").alias("local_idx"), F.col("convo").alias("conversation"))
    return R.as_strings(R.single_corpus(rows, "one"), C.render_human_only).select("local_idx", "text")


# ---- occupational tables -------------------------------------------------------


def _csv(t, df, sep=","):
    place = _place(t)
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(place)
    return place


def _edges(t):
    return t.task_dwa.select(
        F.col("title").alias("Title"), F.concat(F.col("task"), F.lit(", \"daily\"")).alias("Task"),
        F.col("dwa_id").alias("DWA ID"), F.col("dwa_title").alias("DWA Title"),
    )


@query("source_task_dwa", """
    SELECT title, task || ', "daily"' AS task, CAST(dwa_id AS VARCHAR) AS dwa_id, dwa_title FROM {task_dwa}""")
def source_task_dwa(t):
    return R.task_dwa(t.spark, _csv(t, _edges(t)))


@query("source_dwa_iwa", "SELECT CAST(dwa_id AS VARCHAR) AS dwa_id, dwa_title, iwa_title FROM {dwa_iwa}")
def source_dwa_iwa(t):
    rows = t.dwa_iwa.select(F.col("dwa_id").alias("DWA ID"), F.col("dwa_title").alias("DWA Title"), F.col("iwa_title").alias("IWA Title"))
    return R.dwa_iwa(t.spark, _csv(t, rows))


@query("source_task_tables", """
    SELECT 'edge' AS kind, title AS category_occ, task || ', "daily"' AS category_task, dwa_title AS dwa FROM {task_dwa}
    UNION SELECT 'space', title, task || ', "daily"', NULL FROM {task_dwa}""")
def source_task_tables(t):
    """Both tables of a pull, written and read again."""
    place = _place(t)
    W.write_task_tables(*R.split_task_tables(R.task_dwa(t.spark, _csv(t, _edges(t)))), place)
    edges = t.spark.read.parquet(f"{place}/task_dwa").select(F.lit("edge").alias("kind"), "category_occ", "category_task", "dwa")
    space = t.spark.read.parquet(f"{place}/task_space")
    return edges.union(space.select(F.lit("space"), "category_occ", "category_task", F.lit(None).cast("string")))


@query("source_desires", "SELECT DISTINCT title AS category_occ, task AS category_task FROM {task_dwa}")
def source_desires(t):
    rows = t.task_dwa.select(F.col("title").alias("Occupation (O*NET-SOC Title)"), F.col("task").alias("Task"), F.lit(1).alias("Desire")).distinct()
    return R.desires(t.spark, _csv(t, rows)).select("category_occ", "category_task")


@query("source_reference_labels", "SELECT CAST(p_partkey AS VARCHAR) AS task, 'E' || p_size % 4 AS reference_label FROM {part}")
def source_reference_labels(t):
    rows = t.part.select(F.col("p_partkey").alias("Task"), F.concat(F.lit("E"), (F.col("p_size") % 4).cast("string")).alias("Label"))
    return R.reference_labels(t.spark, _csv(t, rows, "\t"), {"Task": "task", "Label": "reference_label"})


@query("source_occupations", "SELECT c_mktsegment || ' ' || c_custkey AS category_occ FROM {customer} WHERE c_custkey % 5 > 0")
def source_occupations(t):
    """One occupation per line; blank lines are dropped."""
    place = _place(t)
    line = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string"), F.lit("\t")))
    t.customer.select(line.alias("value")).write.text(place)
    return R.occupation_list(t.spark, place)


# ---- questions, answers, predictions, judgments ----------------------------------


@query("source_questions", f"""
    SELECT CAST(conv_id AS VARCHAR) AS uid, CASE conv_id % 2 WHEN 0 THEN 'multi' ELSE 'single' END AS format,
           CASE conv_id % 2 WHEN 0 THEN {_TEXT} ELSE 'Human: ' || arg_min(text, turn) END AS text
    FROM {{turns}} WHERE role = 'user' GROUP BY conv_id""")
def source_questions(t):
    """Single-turn and multi-turn question files through one reader."""
    users = convo_ops.from_turns(t.turns.filter("role = 'user'"))
    named = users.select(F.col("conv_id").cast("string").alias("uid"), F.lit("ei").alias("category"), F.lit("0").alias("subcategory"), "convo")
    even = F.col("uid").cast("bigint") % 2 == 0
    parts = {
        "multi": named.filter(even),
        "single": named.filter(~even).select("uid", "category", "subcategory", F.get("convo", F.lit(0))["content"].alias("prompt")),
    }
    out = []
    for name, df in parts.items():
        place = _place(t)
        df.write.json(place)
        found = R.question_format(t.spark.read.json(place))
        out.append(R.questions(t.spark, place).select("uid", F.lit(found).alias("format"), C.render("convo").alias("text")))
    return out[0].union(out[1])


def _predictions(t):
    """A prediction per user and event type with its token counts."""
    first = t.events.groupBy(F.col("user_id").alias("idx"), F.col("event_type").alias("model")).agg(F.min("event_id").alias("e"))
    return first.select(
        "idx", "model", F.md5(F.col("idx").cast("string")).alias("convo_hash"), F.concat(F.lit("r"), F.col("e").cast("string")).alias("request_hash"),
        F.when(F.col("e") % 4 > 0, F.concat(F.lit("answer\n"), F.col("e").cast("string"))).alias("response"),
        F.when(F.col("e") % 4 == 0, F.lit("timeout")).alias("error"),
        F.col("e").alias("total_tokens"), (F.col("e") % 50).alias("prompt_tokens"), (F.col("e") % 7).alias("completion_tokens"),
        (F.col("e") % 3).alias("reasoning_tokens"),
    )


_FIRST = "first AS (SELECT user_id AS idx, event_type AS model, min(event_id) AS e FROM {events} GROUP BY ALL)"


@query("sink_predictions", "WITH " + _FIRST + """
    SELECT idx, model, md5(CAST(idx AS VARCHAR)) AS convo_hash, 'r' || e AS request_hash, CASE WHEN e % 4 > 0 THEN 'answer' || chr(10) || e END AS response,
           CASE WHEN e % 4 = 0 THEN 'timeout' END AS error FROM first""")
def sink_predictions(t):
    """Predictions by model in two runs, one of them repeated, read with the model of their folder."""
    place, rows = _place(t), _predictions(t)
    for run, part in (("0", "idx % 3 > 0"), ("1", "idx % 3 = 0"), ("0", "idx % 3 > 0")):
        W.write_predictions(rows.filter(part), place, run=run)
    return R.predictions(t.spark, f"{place}/predictions").select("idx", "model", "convo_hash", "request_hash", "response", "error")


@query("sink_token_log", "WITH " + _FIRST + """
    SELECT idx, e AS total_tokens, e % 50 AS prompt_tokens, e % 7 AS completion_tokens, e % 3 AS reasoning_tokens FROM first""")
def sink_token_log(t):
    place = _place(t)
    W.write_predictions(_predictions(t), place)
    names = ["idx", "total_tokens", "prompt_tokens", "completion_tokens", "reasoning_tokens"]
    return t.spark.read.json(f"{place}/tokens").select(*names)


@query("prediction_models", "SELECT DISTINCT event_type AS model FROM {events}")
def prediction_models(t):
    """Models found from the prediction files."""
    place = _place(t)
    W.write_predictions(_predictions(t), place)
    return R.model_names(R.predictions(t.spark, f"{place}/predictions"))


def _exported(t):
    convos = convo_ops.from_turns(t.turns.filter("role = 'user'")).select(
        F.col("conv_id").alias("idx"), (F.col("conv_id") % 10).alias("category_idx"),
        F.concat(F.lit("dwa "), (F.col("conv_id") % 10).cast("string")).alias("dwa"), F.col("convo").alias("convo_subset"),
    )
    preds = _predictions(t).select("idx", "model", "response").withColumn("response", F.coalesce("response", F.lit("none")))
    place = _place(t)
    W.write_export(convos.join(preds, "idx"), place)
    return place


@query("sink_questions", f"""
    SELECT CAST(conv_id AS VARCHAR) AS uid, CAST(conv_id % 10 AS VARCHAR) AS subcategory, {_TEXT} AS text
    FROM {{turns}} WHERE role = 'user' AND conv_id IN (SELECT user_id FROM {{events}}) GROUP BY conv_id""")
def sink_questions(t):
    """Questions of an export: one per conversation over all models."""
    return R.questions(t.spark, f"{_exported(t)}/questions").select("uid", "subcategory", C.render("convo").alias("text"))


@query("sink_answers", "WITH " + _FIRST + """
    SELECT CAST(idx AS VARCHAR) AS uid, model, CASE WHEN e % 4 > 0 THEN 'answer' || chr(10) || e ELSE 'none' END AS answer
    FROM first WHERE idx IN (SELECT conv_id FROM {turns} WHERE role = 'user')""")
def sink_answers(t):
    """Answers of an export, a partition per model."""
    out = R.answers(t.spark, f"{_exported(t)}/answers")
    return out.select("uid", "model", C.last_content("messages").alias("answer"))


@query("sink_categories", """
    SELECT conv_id % 10 AS subcategory_idx, 'dwa ' || conv_id % 10 AS subcategory_name FROM {turns}
    WHERE role = 'user' AND conv_id IN (SELECT user_id FROM {events}) GROUP BY ALL""")
def sink_categories(t):
    return t.spark.read.json(f"{_exported(t)}/categories").select("subcategory_idx", "subcategory_name")


def _judgment_rows(t):
    def game(c):
        return F.when(F.col(c).isNotNull(), F.struct(
            F.col(c).alias("score"), F.struct(F.concat(F.lit("[["), c, F.lit("]]")).alias("answer")).alias("judgment"),
            F.array(C.turn("user", F.lit("compare"))).alias("prompt"),
        ))

    return t.judgments.select(
        F.col("event_id").cast("string").alias("uid"), F.lit("ei").alias("category"),
        F.concat(F.lit("judge_"), (F.col("event_id") % 3).cast("string")).alias("judge"), "model", F.lit("base").alias("baseline"),
        F.array(game("game1"), game("game2")).alias("games"),
    )


_JUDGED = """
    SELECT CAST(event_id AS VARCHAR) AS uid, 'judge_' || event_id % 3 AS judge, model, game1, game2 FROM {judgments} WHERE event_id % 3 < 2"""


def _games(df):
    score = [F.get("games", F.lit(i))["score"].alias(f"game{i + 1}") for i in (0, 1)]
    return df.select("uid", "judge", "model", *score)


@query("source_judgments", _JUDGED)
def source_judgments(t):
    """Two of three judges, a folder of line files each."""
    place = _place(t)
    for k in range(3):
        _judgment_rows(t).filter(F.col("judge") == f"judge_{k}").write.json(f"{place}/judge_{k}")
    return _games(R.judgments(t.spark, place, ["judge_0", "judge_1"]))


@query("sink_judgments", _JUDGED)
def sink_judgments(t):
    """Judgments as the sink partitions them, written twice."""
    place = _place(t)
    for _ in range(2):
        W.write_judgments(_judgment_rows(t), place)
    return _games(R.written_judgments(t.spark, place, ["judge_0", "judge_1"]))


# ---- rounds, search, leaderboards, descriptions ------------------------------------


@query("sink_rounds", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_idx, step, pred_keep FROM {preds} WHERE round_idx = 0 OR step = 's0'""")
def sink_rounds(t):
    """Steps of rounds, one of them written twice."""
    place, keys = _place(t), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    for r, step in ((0, "s0"), (0, "s1"), (1, "s0"), (0, "s0")):
        rows = t.preds.filter((F.col("round_idx") == r) & (F.col("step") == step)).select(*keys, "pred_keep")
        W.write_round(rows, place, round_idx=r, step=step)
    return t.spark.read.parquet(place).select(*keys, "round_idx", "step", "pred_keep")


@query("source_round_columns", "SELECT o_orderkey, o_custkey FROM {orders}")
def source_round_columns(t):
    """Two columns of one table name over all rounds."""
    place = _place(t)
    for r in range(3):
        W.write_pairs(t.orders.filter(F.col("o_orderkey") % 3 == r), f"{place}/{r}/kept")
        W.write_pairs(t.orders.filter(F.col("o_orderkey") % 3 == r), f"{place}/{r}/other")
    return R.round_columns(t.spark, place, "kept", ["o_orderkey", "o_custkey"])


@query("source_search_result", "SELECT p_partkey, 'q' || p_size AS query FROM {part} WHERE p_size % 2 = 0")
def source_search_result(t):
    """Verified rows of a written search that have a query."""
    place = _place(t)
    text = F.concat(F.lit("q"), F.col("p_size").cast("string"))
    found = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, text).alias("query"))
    W.write_search(found, found.select("p_partkey"), found, place)
    return R.search_result(t.spark, place, ["p_partkey"]).select("p_partkey", "query")


_BOARD = """
    SELECT DISTINCT 'seg ' || c_nationkey AS stratum, c_mktsegment AS model, CASE WHEN c_nationkey % 4 > 0 THEN round(avg(c_acctbal), 2) END AS score
    FROM {customer} GROUP BY c_nationkey, c_mktsegment"""


def _boards(t):
    score = F.when(F.col("c_nationkey") % 4 > 0, F.round(F.avg("c_acctbal"), 2)).otherwise(F.lit(float("nan")))
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(score.alias("score")).select(
        F.concat(F.lit("seg "), F.col("c_nationkey").cast("string")).alias("stratum"), F.col("c_mktsegment").alias("model"), "score"
    )


@query("sink_leaderboards", f"SELECT 'g1/' || stratum AS lb_id, model, score FROM ({_BOARD}) UNION ALL SELECT 'g2/' || stratum, model, score FROM ({_BOARD})")
def sink_leaderboards(t):
    """Rows of two groups, one of them written twice."""
    place = _place(t)
    for group in ("g1", "g2", "g1"):
        W.write_leaderboards(_boards(t), place, group=group)
    return R.leaderboard_rows(t.spark, place).select("lb_id", "model", "score")


@query("sink_manifest", f"SELECT DISTINCT 'g1/' || stratum AS lb_id, 'g1' AS group_id FROM ({_BOARD})")
def sink_manifest(t):
    """Manifest and groups name every leaderboard once after a rerun."""
    place = _place(t)
    for _ in range(2):
        W.write_leaderboards(_boards(t), place, group="g1")
    manifest = t.spark.read.parquet(f"{place}/manifest").select("lb_id")
    return manifest.join(t.spark.read.parquet(f"{place}/groups"), "lb_id").select("lb_id", "group_id")


@query("sink_documents", """
    SELECT model, count(*) AS n_entries FROM (SELECT DISTINCT uid FROM {judgments} WHERE game1 IS NOT NULL AND game2 IS NOT NULL),
           (SELECT DISTINCT model FROM {judgments} WHERE game1 IS NOT NULL AND game2 IS NOT NULL) GROUP BY 1""")
def sink_documents(t):
    """Document entries of every model, one row per question."""
    place = _place(t)
    entries = leaderboards.document_entries(J.with_scores(t.judgments), order=["event_id"])
    W.write_leaderboards(_boards(t), place, group="g", entries=entries)
    return t.spark.read.json(f"{place}/responses/g").groupBy("model").agg(F.count(F.lit(1)).alias("n_entries"))


@query("leaderboard_document", """
    WITH full_ AS (SELECT * FROM {judgments} WHERE game1 IS NOT NULL AND game2 IS NOT NULL),
    once AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY uid, model ORDER BY event_id) = 1),
    u AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS question_idx FROM (SELECT DISTINCT uid FROM full_)), m AS (SELECT DISTINCT model FROM full_)
    SELECT model, question_idx, u.uid, coalesce('answer ' || event_id, '') AS answer,
           coalesce('(Judge output 1):' || chr(10) || '[[' || game1 || ']]' || chr(10) || repeat('-', 80) || chr(10) || '(Judge output 2):' || chr(10) || '[[' || game2 || ']]', '') AS judge,
           coalesce('side B of ' || event_id, '') AS judge_answer
    FROM u CROSS JOIN m LEFT JOIN once USING (uid, model)""")
def leaderboard_document(t):
    """Entries with answers, judge outputs and the answer of side B, for the whole grid."""
    def game(c, side_b):
        body = F.concat(
            F.lit(C.ANSWER_START.format(side="A") + "a" + C.ANSWER_END.format(side="A") + "\n\n" + C.ANSWER_START.format(side="B")),
            side_b, F.lit(C.ANSWER_END.format(side="B")),
        )
        return F.struct(
            F.struct(F.concat(F.lit("[["), c, F.lit("]]")).alias("answer")).alias("judgment"),
            F.array(C.turn("system", F.lit("judge")), C.turn("user", body)).alias("prompt"),
        )

    side_b = F.concat(F.lit("side B of "), F.col("event_id").cast("string"))
    scored = J.with_scores(t.judgments).withColumn("games", F.array(game("game1", F.lit("x")), game("game2", side_b)))
    first = J.once_per_answer(scored, ["event_id"])
    answers = first.select("uid", "model", F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"))
    out = leaderboards.document_entries(scored, order=["event_id"], answers=answers)
    return out.select("model", "question_idx", "uid", "answer", "judge", "judge_answer")


@query("leaderboard_prompts", """
    WITH q AS (SELECT DISTINCT uid FROM {judgments} WHERE game1 IS NOT NULL AND game2 IS NOT NULL)
    SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS question_idx, 'prompt of ' || uid AS convo_text FROM q""")
def leaderboard_prompts(t):
    """Question texts, numbered like the entries; all models have as many entries."""
    scored = J.with_scores(t.judgments)
    asked = t.judgments.select("uid").distinct().withColumn("convo_text", F.concat(F.lit("prompt of "), F.col("uid").cast("string")))
    return leaderboards.prompts(scored, asked, "convo_text").select("uid", "question_idx", "convo_text")


@query("leaderboard_lengths", "SELECT DISTINCT model, CAST(0 AS BIGINT) AS n FROM {judgments} WHERE false")
def leaderboard_lengths(t):
    """Models whose number of entries differs: none."""
    return leaderboards.unequal_lengths(leaderboards.document_entries(J.with_scores(t.judgments), order=["event_id"]))


@query("sink_descriptions", "SELECT s_name AS dwa, upper(s_name) AS dwa_detailed FROM {supplier} UNION ALL SELECT n_name, lower(n_name) FROM {nation}")
def sink_descriptions(t):
    """Description maps as one table per name."""
    place = _place(t)
    W.write_descriptions({
        "dwa": t.supplier.select(F.col("s_name").alias("key"), F.upper("s_name").alias("detailed")),
        "iwa": t.nation.select(F.col("n_name").alias("key"), F.lower("n_name").alias("detailed")),
    }, place)
    both = t.spark.read.parquet(f"{place}/dwa").union(t.spark.read.parquet(f"{place}/iwa"))
    return both.select(F.col("key").alias("dwa"), F.col("detailed").alias("dwa_detailed"))


@query("error_counts", "WITH " + _FIRST + " SELECT model, count(*) AS n, count(*) FILTER (e % 4 = 0) AS n_errors FROM first GROUP BY 1")
def error_counts(t):
    """Errors per model of written predictions."""
    place = _place(t)
    W.write_predictions(_predictions(t), place)
    return P.error_counts(R.predictions(t.spark, f"{place}/predictions"))


@query("token_log_usage", "WITH " + _FIRST + " SELECT model, sum(e) AS total_tokens, count(*) AS n_requests FROM first GROUP BY 1")
def token_log_usage(t):
    return exchange.token_usage(_predictions(t)).select("model", "total_tokens", "n_requests")
