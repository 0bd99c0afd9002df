"""Readers and writers on files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import readers as R
from gaugeworks.sources import sinks as W
from gaugeworks.streaming import results as ST


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if r is not None else "" for r in rows) + "\n")


def test_questions_both_formats(spark, tmp_path):
    write_lines(tmp_path / "q.jsonl", [
        {"uid": "1", "category": "c", "subcategory": "0", "prompt": "hey"}, None,
        {"uid": "2", "category": "c", "subcategory": "1", "convo": [{"role": "user", "content": "a"}]},
    ])
    rows = {r["uid"]: r for r in R.questions(spark, str(tmp_path / "q.jsonl")).collect() if r["uid"]}
    assert rows["1"]["convo"][0]["content"] == "hey" and rows["2"]["subcategory"] == "1"
    write_lines(tmp_path / "bad.jsonl", [{"uid": "1", "convo": [{"role": "assistant", "content": "a"}]}])
    with pytest.raises(Exception, match="end with a user turn"):
        R.questions(spark, str(tmp_path / "bad.jsonl")).collect()


def test_answers_object_content_and_names(spark, tmp_path):
    for m in ("m1", "m2"):
        write_lines(tmp_path / "ans" / f"{m}.jsonl", [{
            "uid": "1", "ans_id": "x", "model": "other", "tstamp": 0.0, "metadata": {"length": 3, "bold": {"a": 1}},
            "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": {"answer": f"by {m}"}}],
        }])
    df = R.answers(spark, str(tmp_path / "ans"))
    got = {r["model"]: r for r in df.collect()}
    assert got["m1"]["messages"][1]["content"] == "by m1"
    assert json.loads(got["m2"]["metadata"]["bold"]) == {"a": 1}
    assert sorted(r["model"] for r in R.model_names(df).collect()) == ["m1", "m2"]


def test_predictions_skip_token_logs(spark, tmp_path):
    row = {"idx": 1, "convo_hash": "h", "request_hash": "r", "response": "x", "error": None}
    write_lines(tmp_path / "p" / "m1.jsonl", [row, None])
    write_lines(tmp_path / "p" / "m1.tokens.jsonl", [{"idx": 1}])
    rows = R.predictions(spark, str(tmp_path / "p")).collect()
    assert [(r["model"], r["response"]) for r in rows] == [("m1", "x")]


def test_judgments_over_judges(spark, tmp_path):
    game = {"score": "A>B", "judgment": {"answer": "t"}, "prompt": [{"role": "user", "content": "p"}]}
    for j in ("j1", "j2"):
        write_lines(tmp_path / j / "m.jsonl", [{"uid": "1", "category": "c", "judge": j, "model": "m", "baseline": "b", "games": [game, None]}])
    df = R.judgments(spark, str(tmp_path), ["j1", "j2"])
    assert df.count() == 2 and df.first()["games"][1] is None


def test_occupational_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Title,Task,DWA ID,DWA Title\nNurse,"Care, daily",1,Care for people\nNurse,"Care, daily",1,Care for people\n')
    edges = R.task_dwa(spark, str(tmp_path / "t.csv"))
    assert edges.first()["task"] == "Care, daily"
    e, space = R.split_task_tables(edges)
    assert e.count() == 1 and space.count() == 1
    W.write_task_tables(e, space, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "task_space")).count() == 1
    (tmp_path / "occ.txt").write_text(" Nurse \n\nClerk\n")
    assert sorted(r[0] for r in R.occupation_list(spark, str(tmp_path / "occ.txt")).collect()) == ["Clerk", "Nurse"]
    (tmp_path / "ref.tsv").write_text("Title\tTask\tLabel\nNurse\tCare\tE1\n")
    ref = R.reference_labels(spark, str(tmp_path / "ref.tsv"), {"Label": "reference_label"})
    assert ref.first()[0] == "E1"
    with pytest.raises(ValueError, match="lacks"):
        R.dwa_iwa(spark, str(tmp_path / "t.csv"))


def test_corpora(spark, tmp_path):
    raw = spark.createDataFrame([('["a"]', '["x"]', '["y"]'), ('["b"]', '["z"]', '["w"]')], "prompt string, response_a string, response_b string")
    df = R.paired_json_corpus(raw.coalesce(1), "arena_55k", use_a=False)
    rows = df.orderBy("local_idx").collect()
    assert [r["local_idx"] for r in rows] == [0, 1] and rows[0]["convo"][1]["content"] == "y"
    other = spark.createDataFrame([(0, [("user", "q")])], "local_idx bigint, conversation array<struct<role:string,content:string>>")
    both = df.unionByName(R.single_corpus(other, "elsewhere"))
    both.write.partitionBy("dset_name").parquet(str(tmp_path / "c"))
    got = R.corpora(spark, str(tmp_path / "c"), "chat_v1")
    assert {r["dset_name"] for r in got.collect()} == {"arena_55k"}
    assert "PartitionFilters: [dset_name" in got._jdf.queryExecution().toString()


def test_numbering_moves_no_text(spark, tmp_path):
    raw = spark.range(500).select(F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("conversation"))
    raw.repartition(7).write.parquet(str(tmp_path / "n"))
    df = R.single_corpus(spark.read.parquet(str(tmp_path / "n")), "n")
    assert sorted(r["local_idx"] for r in df.collect()) == list(range(500))
    assert df.filter("local_idx = 3").collect() == df.filter("local_idx = 3").collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.split("\n") if "Exchange" in line and "convo" in line]
    assert not texts, texts


def test_stream_state_has_a_window(spark, tmp_path):
    write_lines(tmp_path / "in" / "a.json", [{"request_hash": "h", "attempt": 0, "model": "m"}] * 3)
    stream = ST.responses(spark, str(tmp_path / "in")).withColumn("at", F.current_timestamp())
    out = ST.first_results(stream, arrived="at", late="1 hour")
    ST.collect_results(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sided_and_multipart(spark):
    convo = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(0, [("user", "a")], [("user", "b")])], f"local_idx bigint, conversation_a {convo}, conversation_b {convo}")
    assert R.sided_corpus(df, "s", use_a=False).first()["convo"][0]["content"] == "b"
    parts = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"
    bad = spark.createDataFrame([(0, [("user", [("text", "a", "img")])])], f"local_idx bigint, conversation_a {parts}")
    with pytest.raises(Exception, match="more than one part"):
        R.multipart_corpus(bad, "m").collect()


def test_rounds_and_search_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, True)], "instance_idx bigint, pred_keep boolean")
    W.write_round(df, str(tmp_path / "r"), round_idx=0, step="s0")
    W.write_round(df, str(tmp_path / "r"), round_idx=1, step="s0")
    assert spark.read.parquet(str(tmp_path / "r")).filter("round_idx = 1").count() == 1
    for r in (0, 1):
        W.write_pairs(df, str(tmp_path / "pairs" / str(r) / "kept"))
    assert R.round_columns(spark, str(tmp_path / "pairs"), "kept", ["instance_idx"]).count() == 2
    found = spark.createDataFrame([(1, "q"), (2, None)], "id int, query string")
    W.write_search(found, found, found, str(tmp_path / "s"))
    assert R.search_result(spark, str(tmp_path / "s"), ["id"]).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        R.search_result(spark, str(tmp_path / "s"), ["nope"])


def test_export_files(spark, tmp_path):
    convo = "array<struct<role:string,content:string>>"
    merged = spark.createDataFrame(
        [(0, "m1", 3, "d", [("user", "q")], "x"), (0, "m2", 3, "d", [("user", "q")], "y")],
        f"idx bigint, model string, category_idx int, dwa string, convo_subset {convo}, response string",
    )
    W.write_export(merged, str(tmp_path))
    assert spark.read.json(str(tmp_path / "questions")).count() == 1
    answers = R.answers(spark, str(tmp_path / "answers"))
    assert answers.count() == 2
    assert spark.read.json(str(tmp_path / "categories")).first()["subcategory_name"] == "d"
    preds = merged.select("idx", "model", F.lit("h").alias("convo_hash"), F.lit("r").alias("request_hash"), "response",
                          F.lit(None).cast("string").alias("error"), *[F.lit(1).alias(f"{k}_tokens") for k in ("total", "prompt", "completion", "reasoning")])
    W.write_predictions(preds, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "predictions")).filter("model = 'm1'").count() == 1


def test_leaderboard_tables(spark, tmp_path):
    rows = spark.createDataFrame([("ALL", "a", float("nan")), ("s1", "a", 0.5)], "stratum string, model string, score double")
    W.write_leaderboards(rows, str(tmp_path), group="g")
    got = R.leaderboard_rows(spark, str(tmp_path))
    assert got.filter("score IS NULL").count() == 1
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2
    W.write_leaderboards(rows, str(tmp_path), group="g")  # a rerun replaces its group
    W.write_leaderboards(rows, str(tmp_path), group="h")
    assert {r["group_id"] for r in spark.read.parquet(str(tmp_path / "groups")).collect()} == {"g", "h"}
    assert R.leaderboard_rows(spark, str(tmp_path)).count() == 4


def test_streamed_results(spark, tmp_path):
    src, table, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    def line(h, attempt, tokens):
        return {"request_hash": h, "attempt": attempt, "model": "m", "output": "o", "total_tokens": tokens}

    write_lines(src / "a.json", [line("h1", 0, 5), line("h1", 0, 5), line("h2", 0, 7)])
    known = spark.createDataFrame([("h2",)], "request_hash string")
    run = lambda: ST.collect_results(ST.first_results(ST.responses(spark, str(src)), known), table, cp).awaitTermination()
    run()
    write_lines(src / "b.json", [line("h1", 0, 5), line("h3", 1, 2)])
    run()
    assert sorted(r["request_hash"] for r in spark.read.parquet(table).collect()) == ["h1", "h3"]
    q = ST.running_usage(ST.responses(spark, str(src))).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("usage").first()["total_tokens"] == 24
