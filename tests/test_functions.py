"""Edge cases of the column functions on literal rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import conversation as C
from gaugeworks.functions import labels as L
from gaugeworks.functions import text as T


def one(spark, value, fn, ddl="string"):
    df = spark.createDataFrame([(value,)], f"x {ddl}")
    return df.select(fn(F.col("x")).alias("r")).first()["r"]


def by_id(df, fn):
    return {r["id"]: r["r"] for r in df.select("id", fn(F.col("convo")).alias("r")).collect()}


def test_render(convos):
    r = by_id(convos, C.render)
    assert r[1] == "Human: hello\n\nAssistant: hi\n\nHuman: more?"
    assert r[3] == "" and r[4] == "Human: a\n\nAssistant: b"
    assert by_id(convos, C.render_human_only)[1] == "Human: hello\n\nHuman: more?"
    assert by_id(convos, C.render_history)[4] == "User: a\n\nAssistant: b"
    assert by_id(convos, C.user_text)[1] == "hello\nmore?"
    with pytest.raises(Exception, match="other than user or assistant"):
        convos.select(C.render(F.col("convo"), on_system="error")).collect()


def test_counts_and_prefix(convos):
    assert by_id(convos, C.n_user_turns) == {1: 2, 2: 1, 3: 0, 4: 1, 5: 1}
    second = by_id(convos, lambda c: C.prefix_to_user_turn(c, 2))
    assert len(second[1]) == 3 and second[2] is None and second[3] is None
    first = by_id(convos, lambda c: C.prefix_to_user_turn(c, 1))
    assert [t["role"] for t in first[5]] == ["assistant", "user"]


def test_numbered(convos):
    r = by_id(convos, C.numbered_turns)
    assert r[1] == 'Human turn 1: """hello"""\n\nAssistant: """hi"""\n\nHuman turn 2: """more?"""'
    assert r[5].startswith('Assistant: """first"""')


def test_last_previous(convos):
    assert by_id(convos, C.last_content)[1] == "more?"
    assert by_id(convos, C.last_content)[3] is None
    assert by_id(convos, C.previous_turns_xml)[1] == (
        "<turn role='user'>hello</turn>\n<turn role='assistant'>hi</turn>"
    )
    assert by_id(convos, C.ends_with_user)[4] is False
    assert by_id(convos, C.ends_with_user)[3] is False


def test_split_number_drop(spark):
    text = "Human: a\n\nstill a\n\nHuman: b\n\nHuman: c\n"
    parts = one(spark, text, C.split_turns)
    assert parts == ["Human: a\n\nstill a", "Human: b", "Human: c"]
    assert one(spark, text, lambda c: C.number_turns(C.split_turns(c))).startswith("(0) Human: a")
    kept = one(spark, text, lambda c: C.drop_turns(C.split_turns(c), F.array(F.lit(1))))
    assert kept == "Human: a\n\nstill a\n\nHuman: c"


def test_fingerprint(convos):
    expected = json.dumps(
        [{"content": "only", "role": "user"}], separators=(",", ":"), sort_keys=True
    )
    assert by_id(convos, C.fingerprint)[2] == hashlib.sha256(expected.encode()).hexdigest()


def test_replace_append(convos):
    r = by_id(convos, lambda c: C.replace_turn(c, -1, F.lit("new")))
    assert r[1][-1]["content"] == "new" and r[1][0]["content"] == "hello"
    assert by_id(convos, lambda c: C.append_answer(c, F.lit("ans")))[3][0]["role"] == "assistant"


def test_examples(spark):
    df = spark.createDataFrame(
        [([([("user", "q")], "a"), ([("user", "z")], None)],)],
        "e ARRAY<STRUCT<input: ARRAY<STRUCT<role: STRING, content: STRING>>, output: STRING>>",
    )
    plain = df.select(C.examples_text("e")).first()[0]
    assert plain == "### Example\n```\nHuman: q\n\nLLM: a\n```"
    tagged = df.select(C.examples_text("e", style="tagged")).first()[0]
    assert tagged == "### Example\n```\n<human>\nq\n</human>\n\n<LLM>\na\n</LLM>\n```"


def test_paired_json(spark):
    df = spark.createDataFrame([('["a", null, "c"]', '["x", "y"]')], "p string, r string")
    convo = df.select(C.from_paired_json("p", "r")).first()[0]
    assert [(t["role"], t["content"]) for t in convo] == [
        ("user", "a"), ("assistant", "x"), ("user", ""), ("assistant", "y")
    ]


def test_multipart(spark):
    ddl = "c ARRAY<STRUCT<role: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING, image: STRING>>>>"
    rows = [
        ([("user", [("text", "hey", None)]), ("assistant", [])],),
        ([("user", [("text", "hey", "img")])],),
    ]
    df = spark.createDataFrame(rows, ddl)
    out = df.select(C.from_multipart("c").alias("c"), C.multipart_valid("c").alias("ok")).collect()
    assert [t["content"] for t in out[0]["c"]] == ["hey", ""] and out[0]["ok"] is True
    assert out[1]["ok"] is False


def test_server_error_and_side_b(spark):
    prompt = (
        "<|The Start of Assistant A's Answer|>\nfine\n<|The End of Assistant A's Answer|>\n"
        "<|The Start of Assistant B's Answer|>\nServer error\n<|The End of Assistant B's Answer|>"
    )
    assert one(spark, prompt, C.has_server_error) is True
    assert one(spark, None, C.has_server_error) is False
    assert one(spark, prompt, C.judge_prompt_answer_b) == "Server error"


@pytest.mark.parametrize(
    "value,expected",
    [
        ("<answer> b. </answer>", "B"),
        ("<answer>\nA</answer>", None),
        ("<Answer>A</Answer>", None),
        ("<answer>G</answer>", None),
        (None, None),
        ("<answer>A</answer><answer>B</answer>", "A"),
    ],
)
def test_mcq(spark, value, expected):
    assert one(spark, value, L.mcq) == expected


def test_tags(spark):
    text = "<t>one</t> x <t a='1'> two\n</t><t> </t>"
    assert one(spark, text, lambda c: T.tags(c, "t")) == ["one", "two"]
    assert one(spark, "none", lambda c: T.tags(c, "t")) is None
    assert one(spark, "<t>\n a \n</t>", lambda c: T.tag(c, "t")) == "a"
    assert one(spark, "<t></t>", lambda c: T.tag(c, "t")) == ""
    assert one(spark, "<t></t>", lambda c: T.filled_tag(c, "t")) is None


def test_nested_tags_belong_to_the_outer_one(spark):
    text = "<a><b>x</b></a> <b y='1'> z </b><c>1</c><c>2</c>"
    got = one(spark, text, lambda c: L.tag_lists(c, ["b", "a"], require_fence=False))
    assert got["b"] == ["z"] and got["a"] == ["<b>x</b>"]
    assert one(spark, text, lambda c: L.tag_map(c, require_fence=False)) == {"a": ["<b>x</b>"], "b": ["z"], "c": ["1", "2"]}
    assert one(spark, "plain", lambda c: L.tag_map(c, require_fence=False)) == {}


def test_tag_lists(spark):
    names = ["a", "b"]
    fenced = "```xml\n<a>1</a><b x='y'>2</b><a>3</a>\n```"
    r = one(spark, fenced, lambda c: L.tag_lists(c, names))
    assert r["a"] == ["1", "3"] and r["b"] == ["2"]
    assert one(spark, "<a>1</a>", lambda c: L.tag_lists(c, names)) is None
    assert one(spark, "<a>1</a>", lambda c: L.tag_lists(c, names, require_fence=False))["a"] == ["1"]


@pytest.mark.parametrize(
    "value,expected", [("<answer> 3 </answer>", True), ("<answer>0</answer>", False), ("x", False)]
)
def test_positive_int(spark, value, expected):
    assert one(spark, value, L.positive_int) is expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("<answer>1, 2</answer>", [1, 2]),
        ("<answer></answer>", []),
        ("<answer>1, x</answer>", None),
        ("none", None),
    ],
)
def test_index_list(spark, value, expected):
    assert one(spark, value, L.index_list) == expected


def test_letters(spark):
    assert one(spark, "<ANSWER> d </answer>", L.letter_answer) == "D"
    assert one(spark, "<answer>D</answer>", lambda c: L.letter_answer(c, "C")) is None
    assert one(spark, "reasoning E1\nfinal: e2 \n", L.exposure_answer) == "E2"
    assert one(spark, "E1\nnothing", L.exposure_answer) is None
    d = one(spark, "<answer_observed>a</answer_observed>", L.double_answer)
    assert d["observed"] == "A" and d["perfect"] is None
    assert one(spark, "<answer>25-49%</answer>", lambda c: L.allowed_answer(c, ["25-49%"])) == "25-49%"


@pytest.mark.parametrize(
    "value,expected",
    [
        ("[[A>B]] later [[b>>a]]", "B>>A"),
        ("[A=B]", "A=B"),
        ("[x] [[A>>B]] [B>A]", "A>>B"),
        ("nothing", None),
        (None, None),
    ],
)
def test_verdict(spark, value, expected):
    assert one(spark, value, L.verdict) == expected


def test_verdict_scores(spark):
    assert one(spark, "A>>B", L.verdict_scores) == [1.0] * 3
    assert one(spark, "B=A", L.verdict_scores) == [0.5]
    assert one(spark, "??", L.verdict_scores) is None


@pytest.mark.parametrize(
    "value,number,error",
    [
        ("1-2 hours", 90.0, None),
        ("-5 min", None, "negative"),
        ("3 fortnights", None, "unit"),
        ("~ 15 mins", 15.0, None),
        ("<10", 10.0, None),
        ("> 2 hrs", 120.0, None),
        ("20–40", 30.0, None),
        ("NOT_SPECIFIED", 0.0, None),
        ("", 0.0, None),
        ("1.5hr", 90.0, None),
        ("soon", None, "unparsed"),
        ("about 3 min each", 3.0, None),
    ],
)
def test_minutes(spark, value, number, error):
    r = one(spark, value, L.minutes)
    assert (r["value"], r["error"]) == (number, error)


def activity(desc="d", belongs="yes", saved="10 min", orig="1 hour"):
    return (
        f"<activity><activity_description>{desc}</activity_description>"
        f"<belongs_to_task_being_scored>{belongs}</belongs_to_task_being_scored>"
        f"<reported_time_savings_minutes>{saved}</reported_time_savings_minutes>"
        f"<original_time_minutes>{orig}</original_time_minutes></activity>"
    )


def wrap(*blocks):
    return "<activity_task_matches>\n" + "\n".join(blocks) + "\n</activity_task_matches>"


def test_activities(spark):
    r = one(spark, wrap(activity(), activity(belongs="no")), L.activities)
    assert r["error"] is None and len(r["activities"]) == 2
    assert r["activities"][0]["saved"] == 10.0 and r["activities"][0]["original"] == 60.0
    assert one(spark, wrap(activity(desc="")), L.activities)["error"] == "missing field"
    assert one(spark, wrap(activity(belongs="maybe")), L.activities)["error"].startswith("belongs")
    assert one(spark, wrap(activity(saved="9 eons")), L.activities)["error"] == "unit"
    zero = one(spark, wrap(activity(saved="not specified", orig="9 eons")), L.activities)
    assert zero["error"] is None and zero["activities"][0]["original"] == 0.0
    assert one(spark, "nothing", L.activities)["error"] == "missing block"
    assert one(spark, wrap(), L.activities)["error"] == "no activities"


@pytest.mark.parametrize(
    "saved,orig,expected",
    [
        (24.0, 100.0, "0-24%"),
        (25.0, 100.0, "25-49%"),
        (49.0, 100.0, "25-49%"),
        (74.0, 100.0, "50-74%"),
        (75.0, 100.0, "75-100%"),
        (0.0, 0.0, "0-24%"),
        (-1.0, 10.0, None),
        (1.0, -10.0, None),
    ],
)
def test_span(spark, saved, orig, expected):
    df = spark.createDataFrame([(saved, orig)], "s double, o double")
    assert df.select(L.span_of("s", "o")).first()[0] == expected


def test_span_bucket_and_unmatched(spark):
    text = wrap(activity(saved="30 min"), activity(belongs="no", saved="1 hr"))
    assert one(spark, text, lambda c: L.span_bucket(L.activities(c)["activities"])) == "50-74%"
    assert one(spark, text, lambda c: L.n_unmatched(L.activities(c)["activities"])) == 1


def test_email(spark):
    mail = "<Email><subject> s </subject>\n<body>hi\n```\nq1\n```\n</body></Email>"
    r = one(spark, mail, L.email)
    assert (r["email_subject"], r["query_codeblock"], r["query"]) == ("s", "q1", "q1")
    plain = "<email><subject>s</subject><body> ask </body></email>"
    assert one(spark, plain, L.email)["query"] == "ask"
    assert one(spark, plain, lambda c: L.email(c, require_code=True)) is None
    assert one(spark, "<email><subject>s</subject><body> </body></email>", L.email) is None


def test_attachments(spark):
    xml = "<attachment><filename>a&b</filename><filesizeKb> 12 </filesizeKb></attachment>"
    r = one(spark, xml, L.attachments)
    assert r[0]["filename"] == "a&b" and r[0]["filesize_kb"] == 12 and r[0]["description"] is None
    spec = one(spark, xml, lambda c: L.reference_specs(L.attachments_xml(c)))
    assert spec == (
        '<reference_specs>\n  <reference id="1">\n    <name>a&amp;b</name>\n'
        "    <filesizeKb>12</filesizeKb>\n  </reference>\n</reference_specs>"
    )
    assert one(spark, "none", L.attachments_xml) is None


def test_backgrounds_repeats_and_broken_xml(spark):
    def person(i, title):
        return (f'<respondent id="{i}"><job_title>{title}</job_title><years_experience>3</years_experience>'
                "<company_description>c</company_description></respondent>")

    text = ("<responses><backgrounds>" + person(1, "a") + person(2, "b") + person(1, "z") + "</backgrounds><summaries>"
            '<respondent id="1"><summary>s</summary></respondent><respondent id="2"><summary>t</summary></respondent>'
            "</summaries></responses>")
    got = one(spark, text, L.backgrounds)
    assert [(r["respondent_id"], r["job_title"]) for r in got] == [(1, "z"), (2, "b")]
    assert one(spark, text.replace("</summaries>", ""), L.backgrounds) is None
    assert one(spark, text.replace('id="2"><job', "id=2><job"), L.backgrounds) is None


def test_backgrounds(spark):
    def person(i, job="nurse"):
        return (
            f"<respondent id='{i}'><job_title>{job} &amp; co</job_title><years_experience>7</years_experience>"
            f"<company_description>c & d</company_description></respondent>"
        )

    def note(i):
        return f"<respondent><id>{i}</id><summary>s{i}</summary></respondent>"

    good = f"<responses><backgrounds>{person(1)}{person(2)}</backgrounds><summaries>{note(2)}{note(1)}</summaries></responses>"
    r = one(spark, good, L.backgrounds)
    assert [(p["respondent_id"], p["summary"]) for p in r] == [(1, "s1"), (2, "s2")]
    assert r[0]["job_title"] == "nurse & co" and r[0]["company_description"] == "c & d"
    bad = f"<responses><backgrounds>{person(1)}{person(2)}</backgrounds><summaries>{note(1)}</summaries></responses>"
    assert one(spark, bad, L.backgrounds) is None


def test_votes_and_flags(spark):
    assert one(spark, ["A", " B "], L.keep_votes, "array<string>") is True
    assert one(spark, ["A", None], L.keep_votes, "array<string>") is False
    assert one(spark, ["D"], lambda c: L.keep_votes(c, "ABCD"), "array<string>") is True
    assert one(spark, None, lambda c: L.quality_flag(c, yes_is_bad=True)) is True
    assert one(spark, None, lambda c: L.quality_flag(c, yes_is_bad=False)) is False
    assert one(spark, None, L.homework_flag) is False


def test_checklist(spark):
    assert one(spark, [" a  b ", "", None], L.checklist_items, "array<string>") == ["a b"]
    assert one(spark, None, L.checklist_items, "array<string>") == []
    assert one(spark, [True, None, False, True], L.checklist_score, "array<boolean>") == 0.5
    assert one(spark, [], L.checklist_score, "array<boolean>") is None
    text = "<item>Yes</item><item>no</item><item>hm</item>"
    assert one(spark, text, L.yes_no_items) == [True, False, None]
    blocks = one(
        spark, ["x", "y"], lambda c: L.numbered_items(c, "<q id={id}>{checklist_question}</q>"), "array<string>"
    )
    assert blocks == "<q id=1>x</q>\n<q id=2>y</q>"


def test_contrast(spark):
    ok = "<answer>Task one\nThis does not include x.\nMore.</answer>"
    assert one(spark, ok, L.contrast_sentence) == "This does not include x. More."
    assert one(spark, "<answer>only one line</answer>", L.contrast_sentence) is None
    assert one(spark, "<answer>a\nOther</answer>", L.contrast_sentence) is None


def test_clean_result(spark):
    assert one(spark, " a  \n\n\n\nb\t\r\nc ", L.clean_result) == "a\n\nb\nc"
    assert one(spark, None, L.clean_result) == ""


def test_score_maps(spark):
    assert one(spark, "B", lambda c: L.score(c, "synthetic")) == 0.205
    assert one(spark, "Z", lambda c: L.score(c, "new")) is None
    assert one(spark, "30%", lambda c: L.score(c, "interview_cat10")) == 0.3
