"""Queries on the response exchange and on label extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import templates
from ..operators import exchange as X
from ..operators.scale import spread
from ..session import materialised
from .registry import query


def _keyed(t):
    return t.responses.withColumn("request_hash", F.sha2("request_text", 256))


@query("render_template", """
    SELECT p_partkey, 'Task {' || p_name || '} for ' || p_brand || ': ' || p_size || ' units' AS prompt FROM {part}""")
def render_template(t):
    prompt = templates.fill_from("Task {{{p_name}}} for {p_brand}: {p_size} units", ["p_name", "p_brand", "p_size"])
    return t.part.select("p_partkey", prompt.alias("prompt"))


@query("few_shot_prompt", """
    SELECT p_partkey, 'user=Label {x}|assistant=A|user=Label y|assistant=B|user=Label ' || p_name AS flat FROM {part}""")
def few_shot_prompt(t):
    samples = [{"text": "{x}", "label": "A"}, {"text": "y", "label": "B"}]
    turns = templates.few_shot_prefix(samples, "Label {text}", "{label}") + [("user", "Label {p_name}")]
    convo = templates.fill_turns(turns, {"p_name": F.col("p_name")})
    flat = F.array_join(F.transform(convo, lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return t.part.select("p_partkey", flat.alias("flat"))


@query("request_hashes", """
    SELECT doc_id, sha256('{"model":"m1","prompt":' || to_json(text) || '}') AS request_hash FROM {documents}""")
def request_hashes(t):
    return t.documents.select("doc_id", X.request_hash("text", model="m1").alias("request_hash"))


@query("pending_requests", """
    SELECT DISTINCT sha256(request_text) AS request_hash FROM {responses}
    WHERE request_text NOT IN (SELECT request_text FROM {responses} WHERE doc_id % 2 = 0)""")
def pending_requests(t):
    keyed = _keyed(t)
    return X.pending(keyed, keyed.filter("doc_id % 2 = 0"), prompt="request_text").select("request_hash")


@query("join_responses", """
    WITH best AS (SELECT sha256(request_text) AS h, min(doc_id) AS d FROM {responses} GROUP BY 1)
    SELECT r.doc_id, b.output FROM {responses} r JOIN best ON sha256(r.request_text) = h JOIN {responses} b ON b.doc_id = d""")
def join_responses(t):
    """Each distinct text is answered once and joined back to all of its copies."""
    keyed = _keyed(t)
    answered = X.first_valid(keyed.withColumn("attempt", F.col("doc_id")), F.lit(True))
    return X.join_responses(keyed.select("doc_id", "request_hash"), answered).select("doc_id", "output")


@query("first_valid_attempt", """
    WITH v AS (SELECT sha256(request_text) AS request_hash, attempt, doc_id, output FROM {responses} WHERE output LIKE '%<answer>%</answer>%')
    SELECT request_hash, attempt, output FROM v
    QUALIFY row_number() OVER (PARTITION BY request_hash ORDER BY attempt, doc_id) = 1""")
def first_valid_attempt(t):
    keyed = _keyed(t).withColumn("attempt", F.struct("attempt", "doc_id"))
    best = X.first_valid(keyed, L.mcq("output").isNotNull())
    return best.select("request_hash", F.col("attempt.attempt").alias("attempt"), "output")


@query("apply_prompt", """
    WITH best AS (SELECT 'Rate: ' || request_text AS p, min(doc_id) AS d FROM {responses} WHERE output LIKE '%<answer>%' GROUP BY 1)
    SELECT r.doc_id, CASE WHEN b.output LIKE '%<answer>b%' THEN 'B' WHEN b.output LIKE '%A. %' THEN 'A' END AS label
    FROM {responses} r LEFT JOIN best ON 'Rate: ' || r.request_text = p LEFT JOIN {responses} b ON b.doc_id = d""")
def apply_prompt(t):
    """Render, look up the lowest valid attempt, parse."""
    prompt = templates.fill_from("Rate: {request_text}", ["request_text"])
    answered = t.responses.select(
        X.request_hash(prompt, model="judge").alias("request_hash"), F.col("doc_id").alias("attempt"), "output"
    )
    rows = t.responses.select("doc_id", "request_text")
    done = X.apply_prompt(
        rows, prompt, answered, "label", L.mcq, valid=lambda o: L.mcq(o).isNotNull(), params={"model": "judge"}
    )
    return done.select("doc_id", "label")


@query("result_invariant", """
    SELECT event_id FROM {events} WHERE (event_id % 4 = 0) = (event_id % 6 = 0)""")
def result_invariant(t):
    rows = t.events.select(
        "event_id", F.when(F.col("event_id") % 4 != 0, "out").alias("output"),
        F.when(F.col("event_id") % 6 != 0, "err").alias("error"),
    )
    return X.invalid_results(rows).select("event_id")


@query("order_gaps", """
    SELECT count(*) AS n, max(doc_id) + 1 - count(DISTINCT doc_id) AS n_missing, count(*) - count(DISTINCT doc_id) AS n_repeated
    FROM {labels}""")
def order_gaps(t):
    return X.order_gaps(t.labels, "doc_id")


@query("null_answers", """
    SELECT count(*) AS n, count(*) FILTER (output NOT LIKE '%<answer>%') AS n_null FROM {responses}""")
def null_answers(t):
    return X.null_count(t.responses.withColumn("label", L.mcq("output")), "label")


@query("token_usage", """
    WITH l AS (SELECT source AS model, 1000 * count(*) AS token_limit FROM {documents} GROUP BY 1)
    SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS n_requests,
           CAST(sum(total_tokens) AS BIGINT) // 10000 AS milestones, any_value(token_limit) AS token_limit,
           sum(total_tokens) > any_value(token_limit) AS exceeded
    FROM {responses} JOIN l USING (model) GROUP BY ALL""")
def token_usage(t):
    limits = t.documents.groupBy(F.col("source").alias("model")).agg((F.count(F.lit(1)) * 1000).alias("token_limit"))
    return X.token_usage(t.responses, limits, milestone=10_000)


@query("structured_responses", """
    SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(props::JSON->>'k' AS BIGINT) END AS k FROM {events}""")
def structured_responses(t):
    raw = F.when(F.col("event_id") % 5 > 0, F.col("props")).otherwise(F.lit('{"k": 1'))
    return t.events.select("event_id", X.structured(raw, "k BIGINT")["k"].alias("k"))


def _answers(t):
    e = F.col("event_id")
    good = F.format_string('{"k": %d, "inner": {"x": %s, "name": "n"}}', e % 7, F.when(e % 2 == 0, "1.5").otherwise("2"))
    text = F.when(e % 6 == 0, F.lit('{"k": 1')).when(e % 6 == 1, F.lit('{"k": "one", "inner": {"x": 1}}')).when(
        e % 6 == 2, F.lit('{"k": 3, "inner": {"x": null}}')).when(e % 11 == 3, F.lit(None)).otherwise(good)
    return t.events.select("event_id", text.alias("output"))


_FIELDS = {"$.k": "bigint", "$.inner.x": "double"}


@query("structured_variant", """
    SELECT event_id, CASE WHEN event_id % 6 = 2 THEN 3 WHEN event_id % 6 > 2 AND event_id % 11 <> 3 THEN event_id % 7 END AS k,
           CASE WHEN event_id % 6 = 1 THEN 1.0 WHEN event_id % 6 > 2 AND event_id % 11 <> 3 THEN CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 2.0 END END::DOUBLE AS x,
           CASE WHEN event_id % 6 = 2 OR event_id % 6 = 1 OR event_id % 6 = 0 OR event_id % 11 = 3 THEN NULL ELSE 'n' END AS name
    FROM {events}""")
def structured_variant(t):
    """One parse of a response, read by two schemas."""
    rows = _answers(t).select("event_id", F.try_parse_json(F.col("output")).alias("v"))
    numbers, _ = X.structured_fields(F.col("v"), _FIELDS)
    names, _ = X.structured_fields(F.col("v"), {"$.inner.name": "string"})
    return rows.select("event_id", numbers["$.k"].alias("k"), numbers["$.inner.x"].alias("x"), names["$.inner.name"].alias("name"))


@query("response_errors", """
    SELECT error, count(*) AS n FROM (
        SELECT CASE WHEN event_id % 6 = 0 OR (event_id % 6 > 2 AND event_id % 11 = 3) THEN '$: no JSON' WHEN event_id % 6 = 1 THEN '$.k: string'
                    WHEN event_id % 6 = 2 THEN '$.inner.x: missing' END AS error FROM {events}) WHERE error IS NOT NULL GROUP BY error""")
def response_errors(t):
    """Failing responses counted by the path that fails."""
    return X.errors_by_path(_answers(t), "output", _FIELDS)


@query("moderation_flags", """
    SELECT event_id, event_id % 3 = 0 AS flagged, event_id % 6 = 0 AS violence, round(value / 100, 6) AS violence_score FROM {events}""")
def moderation_flags(t):
    """Struct-valued responses of a moderation call."""
    from ..schemas import MODERATION_FIELDS

    body = F.to_json(F.struct(
        (F.col("event_id") % 3 == 0).alias("flagged"),
        F.struct((F.col("event_id") % 6 == 0).alias("violence")).alias("categories"),
        F.struct((F.col("value") / 100).alias("violence")).alias("category_scores"),
    ))
    got = t.events.select("event_id", X.structured(body, MODERATION_FIELDS).alias("m"))
    return got.select(
        "event_id", "m.flagged", F.col("m.categories.violence").alias("violence"),
        F.round("m.category_scores.violence", 6).alias("violence_score"),
    )


@query("label_mcq", """
    SELECT doc_id, CASE WHEN output LIKE '%<answer> A. </answer>%' THEN 'A' WHEN output LIKE '%<answer>b</answer>%' THEN 'B' END AS label FROM {responses}""")
def label_mcq(t):
    return t.responses.select("doc_id", L.mcq("output").alias("label"))


@query("label_tag", """
    SELECT doc_id, nullif(regexp_extract(output, '<answer>\\s*(.*?)\\s*</answer>', 1), '') AS answer,
           nullif(regexp_extract(output, '<thinking>\\s*(.*?)\\s*</thinking>', 1), '') AS thinking FROM {responses}""")
def label_tag(t):
    return t.responses.select(
        "doc_id", L.tag("output", "answer").alias("answer"), L.tag("output", "thinking").alias("thinking")
    )


@query("label_multi", """
    WITH x AS (SELECT page_id, [regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1)] AS l FROM {pages})
    SELECT page_id, len([s FOR s IN l IF s <> '']) AS n_items, array_to_string([s FOR s IN l IF s <> ''], '|') AS items
    FROM x WHERE len([s FOR s IN l IF s <> '']) > 0""")
def label_multi(t):
    """All non-empty tags of a text, in order."""
    found = t.pages.select("page_id", L.tags("html", "li").alias("l")).filter("l IS NOT NULL")
    return found.select(
        "page_id", F.size("l").cast("long").alias("n_items"), F.array_join("l", "|").alias("items")
    )


@query("label_tag_lists", """
    WITH x AS (SELECT page_id, [regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN
                      regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li(?:\\s+[^>]*)?>(.*?)</li>', 1)] AS l FROM {pages})
    SELECT page_id, len(l) AS n_items, CAST(0 AS BIGINT) AS n_links, array_to_string(l, '|') AS items FROM x""")
def label_tag_lists(t):
    """Items of the first list; the links in them belong to the items."""
    first = F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1)
    got = t.pages.select("page_id", L.tag_lists(first, ["li", "a"], require_fence=False).alias("x"))
    return got.select(
        "page_id", F.size("x.li").cast("long").alias("n_items"), F.size("x.a").cast("long").alias("n_links"),
        F.array_join("x.li", "|").alias("items"),
    )


@query("label_tag_map", """
    SELECT doc_id, CASE WHEN contains(output, '<thinking>') THEN 'answer,thinking' WHEN contains(output, '<answer>') THEN 'answer' ELSE '' END AS names,
           nullif(regexp_extract(output, '<answer>\\s*(.*?)\\s*</answer>', 1), '') AS answer FROM {responses}""")
def label_tag_map(t):
    """Every tag of a text and its contents."""
    got = t.responses.select("doc_id", L.tag_map("output", require_fence=False).alias("m"))
    return got.select(
        "doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
        F.get(F.try_element_at("m", F.lit("answer")), F.lit(0)).alias("answer"),
    )


@query("label_letters", """
    SELECT doc_id, CASE WHEN output LIKE '%<answer>b</answer>%' THEN 'B' END AS letter,
           CASE doc_id % 3 WHEN 0 THEN 'E' || doc_id % 4 END AS exposure FROM {responses}""")
def label_letters(t):
    line = F.concat(F.lit("E1 first\nso "), F.when(F.col("doc_id") % 3 == 0, F.lit("e")).otherwise(F.lit("x")),
                    (F.col("doc_id") % 4).cast("string"), F.lit(".\n"))
    return t.responses.select(
        "doc_id", L.letter_answer("output").alias("letter"), L.exposure_answer(line).alias("exposure")
    )


@query("label_interview", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '25-49%' END AS label FROM {events}""")
def label_interview(t):
    word = F.get(F.array(*[F.lit(x) for x in ("YES", " no\n", "25-49%", "maybe")]), (F.col("event_id") % 4).cast("int"))
    output = F.concat(F.lit("ok <Answer>"), word, F.lit("</answer>"))
    return t.events.select("event_id", L.allowed_answer(output, ["yes", "no", "25-49%"]).alias("label"))


@query("label_summary", """
    SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN source END AS summary FROM {documents}""")
def label_summary(t):
    glue = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("\n"))
    return t.documents.select(
        "doc_id", L.summary(F.concat(F.lit("<summary> "), F.col("source"), glue, F.lit("</summary>"))).alias("summary")
    )


@query("label_yes_no", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || '|false' AS items FROM {events}""")
def label_yes_no(t):
    word = F.get(F.array(*[F.lit(x) for x in (" YES ", "no", "perhaps")]), (F.col("event_id") % 3).cast("int"))
    output = F.concat(F.lit("<item id='1'>"), word, F.lit("</item>\n<item>No</item>"))
    items = F.transform(L.yes_no_items(output), lambda x: F.coalesce(x.cast("string"), F.lit("null")))
    return t.events.select("event_id", F.array_join(items, "|").alias("items"))


@query("verdict_last_match", """
    SELECT doc_id, list_last(regexp_extract_all(output, '\\[\\[([AB<>=]+)\\]\\]', 1)) AS verdict FROM {responses}""")
def verdict_last_match(t):
    return t.responses.select("doc_id", L.verdict("output").alias("verdict"))


@query("label_duration", """
    SELECT event_id, CASE WHEN raw_time LIKE '%minutes' THEN CAST(event_id % 90 AS DOUBLE) WHEN raw_time LIKE '%hrs' THEN event_id % 9 * 60.0
           WHEN raw_time LIKE '~%' THEN event_id % 20 + 5.0 WHEN raw_time = 'NOT_SPECIFIED' THEN 0.0 ELSE CAST(raw_time AS DOUBLE) END AS minutes,
           CAST(NULL AS VARCHAR) AS error FROM {durations}""")
def label_duration(t):
    return t.durations.select("event_id", L.minutes("raw_time").alias("m")).select(
        "event_id", F.col("m.value").alias("minutes"), F.col("m.error").alias("error")
    )


_MIN = """CASE WHEN raw_time LIKE '%minutes' THEN CAST(event_id % 90 AS DOUBLE) WHEN raw_time LIKE '%hrs' THEN event_id % 9 * 60.0
          WHEN raw_time LIKE '~%' THEN event_id % 20 + 5.0 WHEN raw_time = 'NOT_SPECIFIED' THEN 0.0 ELSE CAST(raw_time AS DOUBLE) END"""


def activity_outputs(t):
    """Activity matching output: two activities per event, some of them malformed."""
    def block(belongs, saved, original):
        return F.concat(
            F.lit("<activity>\n<activity_description> a </activity_description><belongs_to_task_being_scored>"),
            belongs, F.lit("</belongs_to_task_being_scored><reported_time_savings_minutes>"), saved,
            F.lit("</reported_time_savings_minutes><original_time_minutes>"), original,
            F.lit("</original_time_minutes></activity>"),
        )

    word = F.when(F.col("event_id") % 7 == 0, "perhaps").when(F.col("event_id") % 2 == 0, "Yes").otherwise("no")
    hour = F.concat((F.col("event_id") % 4).cast("string"), F.lit(" hours"))
    body = F.concat(block(F.lit("yes"), F.col("raw_time"), F.lit("1.5 hrs")), F.lit("\n"), block(word, F.lit("10-20 min"), hour))
    return spread(t.durations).select(
        "event_id", "user_id",
        F.concat(F.lit("x <activity_task_matches>"), body, F.lit("</activity_task_matches>")).alias("output"),
    )


_ACT = f"""
    WITH a AS (SELECT event_id, user_id, event_id % 7 = 0 AS bad, event_id % 2 = 0 AS second, raw_time = 'NOT_SPECIFIED' AS missing,
                      {_MIN} AS m FROM {{durations}}),
    b AS (SELECT event_id, user_id, bad, second,
                 CASE WHEN missing THEN 0 ELSE m END + CASE WHEN second THEN 15 ELSE 0 END AS saved,
                 CASE WHEN missing THEN 0 ELSE 90 END + CASE WHEN second THEN event_id % 4 * 60 ELSE 0 END AS orig FROM a),
    s AS (SELECT *, CASE WHEN bad THEN NULL WHEN orig = 0 THEN '0-24%' WHEN saved / orig <= 0.24 THEN '0-24%' WHEN saved / orig <= 0.49 THEN '25-49%'
                   WHEN saved / orig <= 0.74 THEN '50-74%' ELSE '75-100%' END AS span,
                 CASE WHEN NOT bad THEN CASE WHEN second THEN 0 ELSE 1 END END AS n_unmatched,
                 CASE WHEN bad THEN 'belongs must be yes or no' END AS error FROM b)
"""


def scored_activities(t):
    parsed = activity_outputs(t).withColumn("p", L.activities("output"))
    return parsed.select(
        "event_id", "user_id", L.span_bucket("p.activities").alias("span"),
        F.when(F.col("p.error").isNull(), L.n_unmatched("p.activities")).cast("long").alias("n_unmatched"),
        F.col("p.error").alias("error"),
    )


@query("span_bucket", _ACT + "SELECT event_id, span, n_unmatched, error FROM s")
def span_bucket(t):
    return scored_activities(t).drop("user_id")


@query("activity_rows", _ACT + """
    SELECT event_id, 0 AS i, true AS belongs, CASE WHEN missing THEN 0 ELSE m END AS saved, CASE WHEN missing THEN 0.0 ELSE 90.0 END AS original FROM a WHERE NOT bad
    UNION ALL SELECT event_id, 1, second, 15.0, CAST(event_id % 4 * 60 AS DOUBLE) FROM a WHERE NOT bad""")
def activity_rows(t):
    """One row per parsed activity."""
    # written once: exploding an expression would parse the text several times
    parsed = materialised(activity_outputs(t).select("event_id", L.activities("output")["activities"].alias("a")))
    rows = parsed.select("event_id", F.posexplode("a").alias("i", "x"))
    return rows.select("event_id", "i", "x.belongs", "x.saved", "x.original")


@query("index_list", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN '1|' || event_id % 9 WHEN 1 THEN '' END AS excluded FROM {events}""")
def index_list(t):
    inner = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("1, "), (F.col("event_id") % 9).cast("string"))).when(
        F.col("event_id") % 3 == 1, F.lit(" \n ")).otherwise(F.lit("1, two"))
    output = F.concat(F.lit("<answer>"), inner, F.lit("</answer>"))
    return t.events.select("event_id", F.array_join(L.index_list(output), "|").alias("excluded"))


@query("clean_results", r"""
    WITH a AS (SELECT doc_id, regexp_replace(text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ', '^\s+|\s+$', '', 'g') AS x FROM {documents}),
    b AS (SELECT doc_id, regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t\v\f]+$', '', 'g') AS x FROM a)
    SELECT doc_id, regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g') AS cleaned FROM b""")
def clean_results(t):
    raw = F.concat("text", F.lit("  \n\n\n\nend "))
    return t.documents.select("doc_id", L.clean_result(raw).alias("cleaned"))


@query("email_parse", """
    SELECT doc_id, source AS email_subject, CASE doc_id % 2 WHEN 0 THEN lang || ' code' ELSE 'plain ' || lang END AS query,
           CASE doc_id % 2 WHEN 0 THEN lang || ' code' END AS query_codeblock FROM {documents} WHERE doc_id % 5 > 0""")
def email_parse(t):
    fence = F.concat(F.lit("see:\n```text\n"), F.col("lang"), F.lit(" code\n```\nbye"))
    body = F.when(F.col("doc_id") % 2 == 0, fence).otherwise(F.concat(F.lit("plain "), F.col("lang")))
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(body)
    mail = F.concat(F.lit("Sure.\n<email>\n<subject> "), F.col("source"), F.lit("</subject>\n<body>"), body, F.lit("</body>\n</email>"))
    got = t.documents.select("doc_id", L.email(mail).alias("m")).filter("m IS NOT NULL")
    return got.select("doc_id", "m.email_subject", "m.query", "m.query_codeblock")


@query("attachment_specs", """
    SELECT doc_id, n_chars AS size_kb, '<reference_specs>' || chr(10) || '  <reference id="1">' || chr(10) || '    <name>' || source || ' &amp; co</name>' || chr(10)
           || '    <filesizeKb>' || n_chars || '</filesizeKb>' || chr(10) || '  </reference>' || chr(10) || '  <reference id="2">' || chr(10)
           || '    <name>attachment_2</name>' || chr(10) || '    <description>' || lang || '</description>' || chr(10) || '  </reference>' || chr(10) || '</reference_specs>' AS specs
    FROM {documents}""")
def attachment_specs(t):
    raw = F.concat(
        F.lit("<attachment><filename>"), F.col("source"), F.lit(" & co</filename><filesizeKb> "), F.col("n_chars").cast("string"),
        F.lit("</filesizeKb></attachment>\n<Attachment><description>"), F.col("lang"), F.lit("</description></Attachment>"),
    )
    return t.documents.select(
        "doc_id", F.get(L.attachments(raw), F.lit(0))["filesize_kb"].cast("long").alias("size_kb"),
        L.reference_specs(L.attachments_xml(raw)).alias("specs"),
    )


@query("generated_references", """
    SELECT doc_id, source || '|' || lang AS refs FROM {documents}""")
def generated_references(t):
    raw = F.concat(F.lit("<referenceOutput>\n"), F.col("source"), F.lit("</referenceOutput> <referenceoutput>"), F.col("lang"),
                   F.lit("</referenceoutput><referenceOutput> </referenceOutput>"))
    return t.documents.select("doc_id", F.array_join(L.generated_references(raw), "|").alias("refs"))


@query("respondent_backgrounds", """
    SELECT c_custkey, 1 AS respondent_id, c_name AS job_title, c_nationkey AS years_experience, 'seg & ' || c_mktsegment AS company_description, 'sum 1' AS summary
    FROM {customer} WHERE c_custkey % 4 > 0
    UNION ALL SELECT c_custkey, 2, c_name || ' 2', c_nationkey + 1, 'second', 'sum 2' FROM {customer} WHERE c_custkey % 4 > 0""")
def respondent_backgrounds(t):
    """Respondent XML to one row per respondent; an incomplete batch is rejected whole."""
    def person(i, job, years, company):
        return F.concat(F.lit(f'<respondent id="{i}"><job_title>'), job, F.lit("</job_title><years_experience>"), years.cast("string"),
                        F.lit("</years_experience><company_description>"), company, F.lit("</company_description></respondent>"))

    nation = F.col("c_nationkey")
    second = F.when(F.col("c_custkey") % 4 > 0, F.lit("<respondent id='2'><summary>sum 2</summary></respondent>")).otherwise(F.lit(""))
    xml = F.concat(
        F.lit("```xml\n<responses><backgrounds>"),
        person(1, F.col("c_name"), nation, F.concat(F.lit("seg & "), F.col("c_mktsegment"))),
        person(2, F.concat("c_name", F.lit(" 2")), nation + 1, F.lit("second")),
        F.lit("</backgrounds><summaries><respondent><id>1</id><summary> sum 1</summary></respondent>"), second,
        F.lit("</summaries></responses>\n```"),
    )
    rows = spread(t.customer).select("c_custkey", F.explode(L.backgrounds(xml)).alias("b"))
    return rows.select("c_custkey", "b.*")


@query("score_map", """
    SELECT doc_id, CASE WHEN output LIKE '%<answer>b</answer>%' THEN CAST(0.205 AS DOUBLE) WHEN output LIKE '% A. %' THEN 0.05 END AS beta FROM {responses}""")
def score_map(t):
    return t.responses.select("doc_id", L.score(L.mcq("output", "ABCDE"), "synthetic").alias("beta"))


@query("checklist_score", """
    SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round((CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END + CASE event_id % 2 WHEN 0 THEN 1 ELSE 0 END) / 3.0, 6) END AS score FROM {events}""")
def checklist_score(t):
    answers = F.array(
        F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0, F.lit(None).cast("boolean")
    )
    some = F.when(F.col("event_id") % 10 > 0, answers).otherwise(F.array().cast("array<boolean>"))
    return t.events.select("event_id", F.round(L.checklist_score(some), 6).alias("score"))


@query("checklist_items", r"""
    WITH x AS (SELECT doc_id, [regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') FOR s IN string_split(text, chr(10))] AS a FROM {documents}), y AS (SELECT doc_id, [s FOR s IN a IF s <> ''] AS l FROM x)
    SELECT doc_id, len(l) AS n_items, array_to_string(l, chr(10)) AS items FROM y""")
def checklist_items(t):
    items = t.documents.select("doc_id", L.checklist_items(F.split("text", "\n")).alias("l"))
    return items.select("doc_id", F.size("l").cast("long").alias("n_items"), F.array_join("l", "\n").alias("items"))


@query("checklist_prompt", """
    SELECT p_partkey, '<item id="1">' || p_name || '</item>' || chr(10) || '<item id="2">' || p_brand || '</item>' AS block FROM {part}""")
def checklist_prompt(t):
    template = '<item id="{id}">{checklist_question}</item>'
    return t.part.select("p_partkey", L.numbered_items(F.array("p_name", "p_brand"), template).alias("block"))
