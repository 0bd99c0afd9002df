"""Exchange, interviews, search and hierarchy on small tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import templates
from gaugeworks.operators import conversations, exchange, exposure, hierarchy, rounds, vectors
from gaugeworks.operators import predictions as P
from gaugeworks.plans import asking, interviews, synthesis


def test_templates(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(templates.fill_from("{{k}}: {a}/{b}", ["a", "b"])).first()[0] == "{k}: x/None"
    with pytest.raises(ValueError, match="not among"):
        templates.fill_from("{c}", ["a"])
    with pytest.raises(ValueError, match="placeholder"):
        templates.fields("{a!r}")
    with pytest.raises(ValueError, match="lacks"):
        templates.few_shot_prefix([{"text": "t"}], "{text}", "{label}")


def test_function_is_asked_once_per_distinct_prompt(spark, tmp_path):
    log = str(tmp_path / "calls")

    def responder(prompts: pd.Series) -> pd.DataFrame:
        with open(log, "a") as f:
            for p in prompts:
                f.write(p + "\n")
        return pd.DataFrame({"output": prompts.str.upper()})

    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, text string").repartition(3)
    out = asking.ask_column(df, F.col("text"), "answer", asking.from_function(responder))
    assert {(r["text"], r["answer"]) for r in out.collect()} == {("a", "A"), ("b", "B")}
    out.count()
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_known_responses_and_pending(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    known = spark.createDataFrame([("a",)], "text string").select(
        exchange.request_hash("text", model="m").alias("request_hash"), F.lit(0).alias("attempt"), F.lit("known").alias("output")
    )
    only = asking.ask_column(df, F.col("text"), "o", asking.from_table(known), model="m")
    assert {r["text"]: r["o"] for r in only.collect()} == {"a": "known", "b": None, None: None}
    both = asking.ask_column(df, F.col("text"), "o", asking.with_known(known, asking.from_column(F.upper)), model="m")
    assert {r["text"]: r["o"] for r in both.collect()} == {"a": "known", "b": "B", None: None}
    keyed = df.filter("text IS NOT NULL").withColumn("request_hash", exchange.request_hash("text", model="m"))
    assert [r["text"] for r in exchange.pending(keyed, known, prompt="text").collect()] == ["b"]


def test_lowest_valid_attempt(spark):
    r = spark.createDataFrame([("h", 0, "bad"), ("h", 2, "good2"), ("h", 1, "good1")], "request_hash string, attempt int, output string")
    assert exchange.first_valid(r, F.startswith("output", F.lit("good"))).first()["output"] == "good1"


def test_invariant_gaps_usage(spark):
    r = spark.createDataFrame([("m", "o", None, 6), ("m", None, "e", 5), ("n", "o", "e", 1), ("n", None, None, 2)], "model string, output string, error string, total_tokens long")
    assert exchange.invalid_results(r).count() == 2
    limits = spark.createDataFrame([("m", 11), ("n", 2)], "model string, token_limit long")
    used = {x["model"]: (x["total_tokens"], x["milestones"], x["exceeded"]) for x in exchange.token_usage(r, limits, milestone=5).collect()}
    assert used == {"m": (11, 2, False), "n": (3, 0, True)}
    idx = spark.createDataFrame([(0,), (2,), (2,)], "idx long")
    assert tuple(exchange.order_gaps(idx).first()) == (3, 1, 1)
    assert exchange.args_hash({"b": 1, "a": 2}) is not None


def test_structured(spark):
    df = spark.createDataFrame([('{"is_low_quality": true}',), ("{oops",), (None,)], "o string")
    got = [r[0] for r in df.select(exchange.structured("o", "is_low_quality BOOLEAN")["is_low_quality"]).collect()]
    assert got == [True, None, None]


def test_interview_restart(spark):
    messages = [
        {"role": "user", "content": "hello {name}"},
        {"role": "assistant", "content": {"system": "s1"}},
        {"role": "assistant", "content": {"system": "s2"}},
    ]

    def ask(requests):
        return requests.select("request_hash", F.array_join(F.transform("prompt", lambda m: m["content"]), "|").alias("output"))

    df = spark.createDataFrame([("Al",)], "name string")
    full = interviews.run_interview(df, messages, ask).first()
    assert full["_result_1"] == "s1|hello Al" and full["_result_2"] == "s2|hello Al|s1|hello Al"
    again = interviews.run_interview(df.withColumn("_result_1", F.lit("kept")), messages, ask, start_from=2).first()
    assert again["_result_1"] == "kept" and again["_result_2"] == "s2|hello Al|kept"
    with pytest.raises(ValueError, match="response turns"):
        interviews.run_interview(df, messages, ask, start_from=0)
    with pytest.raises(ValueError, match="no response turn"):
        interviews.run_interview(df, messages[:1], ask)


def test_search_order_and_stop(spark):
    base = spark.createDataFrame([(0,), (1,), (2,)], f"{synthesis.ROW} int")

    def generate(pending):
        made = pending.withColumn("n", F.explode(F.array(F.lit(2), F.lit(1))))
        return made.withColumn("query", F.when(F.col(synthesis.ROW) < 2, F.lit("q")))

    def verify(df, column):
        return df.withColumn(column, (F.col(synthesis.ROW) == 0) | (F.col("time_savings") == "b"))

    verified, missing, seen = synthesis.search(base, ["a", "b", "c"], generate, [verify], order=["n"])
    assert sorted((r[synthesis.ROW], r["time_savings"], r["n"]) for r in verified.collect()) == [(0, "a", 1), (1, "b", 1)]
    assert [r[0] for r in missing.collect()] == [2]
    assert seen.groupBy("time_savings").count().filter("time_savings = 'a'").first()["count"] == 4
    with pytest.raises(ValueError, match="verifier"):
        synthesis.search(base, ["a"], generate, [], order=["n"])


def test_m1_join_fails_on_repeats(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="repeat on the right side"):
        hierarchy.join_m1(left, right, ["k"]).collect()
    assert hierarchy.join_m1(left, right.filter("v <> 'c'"), ["k"]).count() == 2


def test_large_groups_are_whole(spark):
    rows = [("o", "t1", d) for d in "abc"] + [("o", "t2", d) for d in "abcdefgh"]
    edges = spark.createDataFrame(rows, "title string, task string, dwa string")
    pairs = hierarchy.adjacent_dwas(edges)
    assert {(r["dwa"], r["adjacent"]) for r in pairs.collect()} == {(x, y) for x in "abcdefgh" for y in "abcdefgh" if x != y}
    # 1,500 activities of one task, 3,000 tasks of one occupation
    many = spark.range(1500).select(F.lit("o").alias("title"), F.lit("t").alias("task"), F.col("id").cast("string").alias("dwa"))
    found = hierarchy.adjacent_dwas(many)
    assert found.count() == 1500 * 1499
    text = hierarchy.does_not_include(many, found, prompt="{unrelated}", criteria="c")
    sizes = text.select(F.size(F.split(F.trim("does_not_include_prompt"), "- "))).distinct().collect()
    assert text.count() == 1500 and [r[0] for r in sizes] == [1500]
    tasks = spark.range(3000).select(F.lit("o").alias("title"), F.col("id").cast("string").alias("task"))
    rows_ = hierarchy.sibling_tasks(tasks).filter("task IN ('0', '2999')")
    assert {r["task"]: len(r["others"]) for r in rows_.collect()} == {"0": 2999, "2999": 2999}
    listed = hierarchy.occupation_tasks(tasks, occ="title", task="task").first()["occupation_tasks"].split("\n")
    assert listed == [f"- {k}" for k in sorted(str(i) for i in range(3000))]


def test_matching_prompt_has_all_tasks(spark):
    tasks = spark.range(3000).select(F.lit("o").alias("category_occ"), F.col("id").cast("string").alias("category_task"))
    rows = spark.createDataFrame([(1, "o", "<r>x</r>")], "k int, category_occ string, result string")

    def ask(requests):
        return requests.select("request_hash", F.size(F.split("prompt", "\n")).cast("string").alias("output"))

    out = interviews.match_activities(rows, tasks, "{occupation_tasks}", "result", ask)
    assert out.first()["matches"] == "3000"
    lost = rows.withColumn("category_occ", F.lit("none"))
    with pytest.raises(Exception, match="no tasks for occupation none"):
        interviews.match_activities(lost, tasks, "{occupation_tasks}", "result", ask).collect()


def test_missing_description_fails(spark):
    pairs = spark.createDataFrame([("a",)], "dwa string")
    table = spark.createDataFrame([("b", "x")], "dwa string, dwa_detailed string")
    with pytest.raises(Exception, match="no dwa_detailed"):
        hierarchy.attach_descriptions(pairs, [("dwa", table)]).collect()


def test_round_without_predictions(spark):
    pairs = spark.createDataFrame([("t", "o", "d", 1)], "category_task string, category_occ string, dwa string, instance_idx long")
    preds = pairs.withColumn("step", F.lit("s")).withColumn("pred_keep", F.lit(None).cast("boolean"))
    assert rounds.survivors(pairs, preds, []).count() == 1
    assert rounds.survivors(pairs, preds, [], on_empty="drop").count() == 0
    assert rounds.survivors(pairs, preds, ["s"]).count() == 0
    assert rounds.occupation_filter(pairs, pairs.limit(0)).count() == 1


def test_deficient_counts_zero(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dwa string, instance_idx long")
    texts = spark.createDataFrame([(1, "same"), (2, "same"), (3, "x")], "instance_idx long, text string")
    got = {r["dwa"]: tuple(r)[1:] for r in rounds.deficient(pairs, pairs.filter("dwa = 'a'"), texts, min_samples=2).collect()}
    assert got == {"a": (2, 1, False), "b": (0, 0, True)}


def test_turn_past_the_end_is_dropped(spark):
    convo = "array<struct<role:string,content:string>>"
    two = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [("t", "o", "d1", 1, two, "2"), ("t", "o", "d1", 1, two, "1"), ("t", "p", "d1", 1, two, "1"), ("t", "o", "d0", 2, two, "3"), ("t", "o", "d9", 3, two[:1], None), ("t", "o", "d9", 4, two, "x")]
    df = spark.createDataFrame(rows, f"category_task string, category_occ string, dwa string, instance_idx long, convo {convo}, answer string")
    got = {(r["dwa"], r["instance_idx"]): (r["picked_turn"], r["category_idx"]) for r in rounds.select_turns(df).collect()}
    assert set(got) == {("d1", 1), ("d9", 3)}
    assert got[("d9", 3)] == (1, 1) and got[("d1", 1)][1] == 0


def test_sample_sizes(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("category_idx"), F.col("id").alias("instance_idx")).filter("category_idx < 2 OR instance_idx < 20")
    kept = P.stratified_sample(df, n=10).groupBy("category_idx").count().collect()
    assert sorted((r[0], r["count"]) for r in kept) == [(0, 10), (1, 10)]
    whole = P.stratified_sample(df, n=10, drop_deficient=False).groupBy("category_idx").count().collect()
    assert sorted((r[0], r["count"]) for r in whole) == [(0, 10), (1, 10), (2, 6)]
    again = P.stratified_sample(df.repartition(7), n=10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, P.stratified_sample(df, n=10).collect()))


def test_export_hash_check(spark):
    convo = "array<struct<role:string,content:string>>"
    turns = spark.createDataFrame([(0, [("user", "q")])], f"idx long, convo_subset {convo}")
    preds = spark.createDataFrame([(0, "stale", None, "e", "m")], "idx long, convo_hash string, response string, error string, model string")
    with pytest.raises(Exception, match="does not match"):
        P.export_join(turns, preds).collect()
    assert P.export_join(turns, preds, strict=False).count() == 0


def test_pool_needs_all_trials(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0])], "c string, embedding array<float>")
    got = {r["c"]: r["embedding"] for r in vectors.mean_pool(df, ["c"]).collect()}
    assert got["a"] == [0.5, 0.5]
    with pytest.raises(Exception, match="2 vectors"):
        vectors.mean_pool(df, ["c"], n_trials=2).collect()


def test_long_conversations_are_whole(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(12_000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: [x["content"] for x in r["convo"]] for r in conversations.from_turns(df).collect()}
    assert got == {1: [f"t{i}" for i in range(12_000)], 2: ["x"]}


def test_retrieval_table_checks(spark):
    space = spark.createDataFrame([("o", "t")], "category_occ string, category_task string")
    with pytest.raises(ValueError, match="not in the task space"):
        exposure.retrieval_table(space, None, None, other_cols=["x"])
    with pytest.raises(ValueError, match="task examples"):
        exposure.retrieval_table(space, None, None, min_coverage=0.3)
    none = exposure.prompt_with_fallback(exposure.retrieval_table(space, None, None), prompt_ret="{examples_strs}", prompt_zs=None)
    assert none.first()["method"] == "none" and none.first()["prompt"] is None
