"""Queries on conversations and the corpus id space."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..operators import conversations as ops
from ..operators import ids as idspace
from ..session import checkpoint_folder
from .registry import Inputs, query

_NL2 = "chr(10) || chr(10)"


def _convos(t: Inputs):
    return ops.from_turns(t.turns)


@query("convo_render", f"""
    SELECT conv_id,
           string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn) AS rendered
    FROM {{turns}} GROUP BY ALL""")
def convo_render(t):
    return _convos(t).select("conv_id", C.render("convo").alias("rendered"))


@query("convo_human_only", f"""
    SELECT conv_id,
           coalesce(string_agg('Human: ' || text, {_NL2} ORDER BY turn) FILTER (role = 'user'), '') AS rendered
    FROM {{turns}} GROUP BY ALL""")
def convo_human_only(t):
    return _convos(t).select("conv_id", C.render_human_only("convo").alias("rendered"))


@query("convo_nosystem", f"""
    SELECT conv_id,
           coalesce(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn)
                    FILTER (role <> 'system'), '') AS rendered
    FROM {{conversations}} GROUP BY ALL""")
def convo_nosystem(t):
    convos = ops.from_turns(t.conversations)
    return convos.select("conv_id", C.render_history("convo").alias("rendered"))


@query("convo_user_text", f"""
    SELECT conv_id,
           coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_text
    FROM {{turns}} GROUP BY ALL""")
def convo_user_text(t):
    return _convos(t).select("conv_id", C.user_text("convo").alias("user_text"))


@query("convo_turn_counts", f"""
    SELECT conv_id, count(*) FILTER (role = 'user') AS n_user_turns, count(*) AS n_turns
    FROM {{turns}} GROUP BY ALL""")
def convo_turn_counts(t):
    return _convos(t).select(
        "conv_id", C.n_user_turns("convo").cast("long").alias("n_user_turns"),
        F.size("convo").cast("long").alias("n_turns"),
    )


@query("convo_numbered_prompt", f"""
    WITH numbered AS (
        SELECT conv_id, turn, role, text,
               sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n
        FROM {{turns}})
    SELECT conv_id,
           string_agg(CASE role WHEN 'user' THEN 'Human turn ' || n || ': ' ELSE 'Assistant: ' END || '\"\"\"' || text || '\"\"\"',
                      {_NL2} ORDER BY turn) AS numbered
    FROM numbered GROUP BY ALL""")
def convo_numbered_prompt(t):
    return _convos(t).select("conv_id", C.numbered_turns("convo").alias("numbered"))


@query("convo_prefix_cut", f"""
    WITH numbered AS (
        SELECT conv_id, turn, role, text,
               sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n
        FROM {{turns}}),
    cuts AS (SELECT conv_id, min(turn) FILTER (n = 2) AS cut FROM numbered GROUP BY ALL)
    SELECT c.conv_id,
           string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn)
           FILTER (turn <= cut) AS prefix
    FROM cuts c JOIN numbered n ON c.conv_id = n.conv_id GROUP BY ALL""")
def convo_prefix_cut(t):
    cut = C.prefix_to_user_turn("convo", 2)
    return _convos(t).select("conv_id", C.render(cut).alias("prefix"))


@query("convo_last_and_previous", f"""
    WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM {{turns}})
    SELECT conv_id, max(text) FILTER (turn = last_turn) AS query,
           coalesce(string_agg('<turn role=''' || role || '''>' || text || '</turn>', chr(10) ORDER BY turn)
                    FILTER (turn < last_turn), '') AS previous_turns
    FROM m GROUP BY ALL""")
def convo_last_and_previous(t):
    return _convos(t).select(
        "conv_id", C.last_content("convo").alias("query"),
        C.previous_turns_xml("convo").alias("previous_turns"),
    )


@query("convo_first_of_role", f"""
    SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user,
           arg_min(text, turn) FILTER (role = 'assistant') AS first_assistant,
           arg_max(role, turn) = 'user' AS ends_with_user
    FROM {{turns}} GROUP BY ALL""")
def convo_first_of_role(t):
    return _convos(t).select(
        "conv_id", C.first_of_role("convo", "user").alias("first_user"),
        C.first_of_role("convo", "assistant").alias("first_assistant"),
        C.ends_with_user("convo").alias("ends_with_user"),
    )


@query("convo_fingerprint", f"""
    SELECT conv_id,
           sha256('[' || string_agg('{{"content":' || to_json(text) || ',"role":' || to_json(role) || '}}', ',' ORDER BY turn) || ']') AS convo_hash
    FROM {{conversations}} GROUP BY ALL""")
def convo_fingerprint(t):
    """Fingerprint of whole conversations, system turns included."""
    return ops.from_turns(t.conversations).select("conv_id", C.fingerprint("convo").alias("convo_hash"))


@query("convo_drop_turns", f"""
    WITH u AS (
        SELECT conv_id, turn, regexp_replace('Human: ' || text, '^\\s+|\\s+$', '', 'g') AS line,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i
        FROM {{turns}} WHERE role = 'user')
    SELECT conv_id,
           string_agg('(' || i || ') ' || line, {_NL2} ORDER BY turn) AS numbered,
           coalesce(string_agg(line, {_NL2} ORDER BY turn) FILTER (i <> 1), '') AS kept
    FROM u GROUP BY ALL""")
def convo_drop_turns(t):
    users = ops.from_turns(t.turns.filter("role = 'user'"))
    turns = users.select("conv_id", C.split_turns(C.render_human_only("convo")).alias("turns"))
    return turns.select(
        "conv_id", C.number_turns("turns").alias("numbered"),
        C.drop_turns("turns", F.array(F.lit(1))).alias("kept"),
    )


@query("convo_replace_and_append", f"""
    WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM {{turns}})
    SELECT conv_id,
           string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END
                      || CASE WHEN turn = last_turn THEN text || '?' ELSE text END, {_NL2} ORDER BY turn)
           || {_NL2} || 'Assistant: done' AS rendered
    FROM m GROUP BY ALL""")
def convo_replace_and_append(t):
    swapped = C.replace_turn("convo", -1, F.concat(C.last_content("convo"), F.lit("?")))
    return _convos(t).select(
        "conv_id", C.render(C.append_answer(swapped, F.lit("done"))).alias("rendered")
    )


@query("convo_lint", """
    SELECT count(DISTINCT conv_id) AS n_clean, count(*) AS n_turns FROM {conversations}""")
def convo_lint(t):
    good, _ = ops.lint_convos(ops.from_turns(t.conversations), "convo")
    return good.agg(
        F.count_distinct("conv_id").alias("n_clean"), F.sum(F.size("convo")).alias("n_turns")
    )


@query("convo_text_dedupe_count", f"""
    WITH texts AS (
        SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn) AS rendered
        FROM {{turns}} GROUP BY conv_id, turn // 10000)
    SELECT count(*) AS n, count(DISTINCT user_id) AS n_instances,
           (SELECT count(DISTINCT rendered) FROM texts WHERE conv_id IN (SELECT user_id FROM {{events}})) AS n_texts
    FROM {{events}}""")
def convo_text_dedupe_count(t):
    pairs = t.events.select(F.col("user_id").alias("conv_id"))
    texts = _convos(t).select("conv_id", C.render("convo").alias("rendered"))
    return ops.dedupe_counts(pairs, texts, "conv_id", "rendered")


@query("source_paired_json", f"""
    WITH sided AS (
        SELECT conv_id, role, text, turn,
               row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i
        FROM {{turns}}),
    paired AS (
        SELECT u.conv_id, u.i, u.text AS p, a.text AS r
        FROM sided u JOIN sided a ON u.conv_id = a.conv_id AND u.i = a.i
        WHERE u.role = 'user' AND a.role = 'assistant')
    SELECT k.conv_id,
           coalesce(string_agg('Human: ' || p || {_NL2} || 'Assistant: ' || r, {_NL2} ORDER BY i), '') AS rendered
    FROM (SELECT DISTINCT conv_id FROM {{turns}}) k
    LEFT JOIN paired USING (conv_id) GROUP BY ALL""")
def source_paired_json(t):
    """Two JSON list columns, as the paired-column corpora have them."""
    both = _convos(t).select(
        "conv_id",
        F.to_json(F.transform(C.of_role("convo", "user"), lambda x: x["content"])).alias("prompt"),
        F.to_json(F.transform(C.of_role("convo", "assistant"), lambda x: x["content"])).alias("response"),
    )
    return both.select(
        "conv_id", C.render(C.from_paired_json("prompt", "response")).alias("rendered")
    )


@query("source_multipart", f"""
    SELECT conv_id,
           string_agg(role || ':' || CASE WHEN turn % 3 = 2 THEN '' ELSE text END, '|' ORDER BY turn) AS flat, true AS valid
    FROM {{turns}} GROUP BY ALL""")
def source_multipart(t):
    """Turns whose content is a list of at most one text part."""
    part = F.struct(
        F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("image")
    )
    none = F.array().cast("array<struct<type:string,text:string,image:string>>")
    rows = t.turns.select(
        "conv_id", "turn", "role",
        F.when(F.col("turn") % 3 == 2, none).otherwise(F.array(part)).alias("content"),
    )
    raw = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("raw")
    )
    fixed = C.from_multipart("raw")
    return raw.select(
        "conv_id",
        F.array_join(F.transform(fixed, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("flat"),
        C.multipart_valid("raw").alias("valid"),
    )


_IDS = """
    WITH sizes AS (SELECT dset_name, count(*) AS n FROM {corpus} GROUP BY 1),
    offsets AS (SELECT dset_name, coalesce(sum(n) OVER (ORDER BY dset_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes),
    ids AS (SELECT c.dset_name, c.local_idx,
                   CAST(o + row_number() OVER (PARTITION BY c.dset_name ORDER BY local_idx) - 1 AS BIGINT) AS instance_idx
            FROM {corpus} c JOIN offsets USING (dset_name)),
    firsts AS (SELECT dset_name, min(instance_idx) AS f FROM ids GROUP BY 1),
    ranges AS (SELECT dset_name, (instance_idx - f) // 20 AS shard_idx, min(instance_idx) AS start, max(instance_idx) + 1 AS stop
               FROM ids JOIN firsts USING (dset_name) GROUP BY ALL)
"""


def _ids(t):
    return idspace.global_ids(t.corpus.drop("text"))


def _ranges(t):
    return idspace.id_ranges(_ids(t), shard_size=20)


@query("global_ids", _IDS + "SELECT dset_name, local_idx, instance_idx FROM ids")
def global_ids(t):
    return _ids(t)


@query("id_ranges", _IDS + "SELECT dset_name, shard_idx, start, stop FROM ranges")
def id_ranges(t):
    return _ranges(t)


@query("shard_contiguity", _IDS + """,
    cut AS (SELECT * FROM ranges WHERE shard_idx <> 1),
    seen AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY start), 0) AS expected_start FROM cut)
    SELECT dset_name, shard_idx, start, stop, expected_start FROM seen WHERE start <> expected_start""")
def shard_contiguity(t):
    return idspace.range_gaps(_ranges(t).filter("shard_idx <> 1"))


@query("range_lookup", _IDS + """
    SELECT event_id, user_id * 7 AS instance_idx, r.dset_name, user_id * 7 - f.f AS local_idx
    FROM {events} LEFT JOIN ranges r ON user_id * 7 >= start AND user_id * 7 < stop
    LEFT JOIN firsts f ON r.dset_name = f.dset_name""")
def range_lookup(t):
    wanted = t.events.select("event_id", (F.col("user_id") * 7).alias("instance_idx"))
    return idspace.lookup(wanted, _ranges(t), shard_size=20)


def _fetch_inputs(t):
    # with system turns, which the rendering leaves out
    convos = ops.from_turns(t.conversations).select(
        F.concat(F.lit("set "), (F.col("conv_id") % 3).cast("string")).alias("dset_name"),
        F.col("conv_id").alias("local_id"), "convo",
    )
    ids = idspace.global_ids(convos.drop("convo"), local="local_id")
    ranges = idspace.id_ranges(ids, shard_size=100)
    firsts = ids.groupBy("dset_name").agg(F.min("instance_idx").alias("first"))
    corpus = (
        convos.join(ids, ["dset_name", "local_id"])
        .join(firsts, "dset_name")
        .select("dset_name", (F.col("instance_idx") - F.col("first")).alias("local_idx"), "convo")
    )
    return t.events.select("event_id", F.col("user_id").alias("instance_idx")), ranges, corpus


_FETCH = f"""
    WITH sizes AS (SELECT 'set ' || conv_id % 3 AS dset_name, count(DISTINCT conv_id) AS n FROM {{turns}} GROUP BY 1),
    offsets AS (SELECT dset_name, coalesce(sum(n) OVER (ORDER BY dset_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes),
    texts AS (SELECT 'set ' || conv_id % 3 AS dset_name, conv_id, string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, {_NL2} ORDER BY turn) AS rendered
              FROM {{turns}} GROUP BY conv_id),
    ids AS (SELECT *, CAST(o + row_number() OVER (PARTITION BY dset_name ORDER BY conv_id) - 1 AS BIGINT) AS instance_idx FROM texts JOIN offsets USING (dset_name))
    SELECT event_id, user_id AS instance_idx, dset_name, CASE dset_name WHEN 'set 1' THEN 'Human: ' ELSE rendered END AS rendered
    FROM {{events}} LEFT JOIN ids ON user_id = instance_idx"""


def _fetched(wanted, ranges, corpus):
    got = idspace.fetch(
        wanted, ranges, corpus, ignored=["set 1"],
        placeholder=F.array(C.turn("user", F.lit(""))), shard_size=100,
    )
    return got.select("event_id", "instance_idx", "dset_name", C.render("convo").alias("rendered"))


@query("fetch_instances", _FETCH)
def fetch_instances(t):
    """Conversation per wanted id; one dataset is ignored and gets a placeholder."""
    return _fetched(*_fetch_inputs(t))


@query("fetch_from_parts", _FETCH)
def fetch_from_parts(t):
    """The same from a corpus laid out in folders, of which only those with a wanted id are read."""
    wanted, ranges, corpus = _fetch_inputs(t)
    place = f"{checkpoint_folder(t.spark)}/corpus-{uuid.uuid4().hex}"
    idspace.write_corpus(corpus, place)
    return _fetched(wanted, ranges, t.spark.read.parquet(place))

