"""What must not grow with the tables: broadcasts, splits, shuffled columns."""

from pyspark.sql import functions as F

from gaugeworks import session
from gaugeworks.operators import diversity, judging, scale
from gaugeworks.plans import asking
from gaugeworks.session import tuned


def plan_of(df):
    """Final plan of a table after a run over all its rows."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def test_compressed_tables_are_not_broadcast(spark, tmp_path):
    """A few MB of file, hundreds of MB of rows: neither side of the judge inputs is broadcast."""
    spark.range(600_000).select(
        F.col("id").alias("uid"), F.lit("c").alias("category"),
        F.expr("array(named_struct('role', 'user', 'content', 'q'))").alias("convo"),
    ).write.parquet(f"{tmp_path}/q")
    tuned(spark)
    q = spark.read.parquet(f"{tmp_path}/q")
    said = F.expr("concat(convo, array(named_struct('role', 'assistant', 'content', concat('by ', model))))")
    answers = q.select("uid", F.explode(F.array(F.lit("m"), F.lit("base"))).alias("model"), "convo").select(
        "uid", "model", said.alias("messages")
    )
    games = judging.judge_inputs(q, answers, "base").select("uid", "model", "game")
    assert "BroadcastExchange" not in plan_of(games)


def test_equal_texts_are_not_weighed(spark, monkeypatch):
    """Groups of one repeated text give the lowest keys without any term."""
    monkeypatch.setattr(diversity, "_count_terms", None)
    rows = [(g, 10 * i + j, t) for j, (g, t) in enumerate([("a", "one text"), ("b", None), ("c", "")]) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id bigint, text string")
    for fit in ("corpus", "group"):
        got = {(r["g"], r["pick"]): r["id"] for r in diversity.diverse_rows(df, ["g"], "id", "text", 2, fit=fit).collect()}
        assert got == {("a", 0): 0, ("a", 1): 10, ("b", 0): 1, ("b", 1): 11, ("c", 0): 2, ("c", 1): 12}


def test_missing_text_is_not_equal(spark):
    df = spark.createDataFrame([("a", 1, "x y"), ("a", 2, None), ("a", 3, "one two three")], "g string, id bigint, text string")
    for fit in ("corpus", "group"):
        assert diversity.diverse_rows(df.filter("id < 3"), ["g"], "id", "text", 1, fit=fit).count() == 1
        assert diversity.diverse_rows(df, ["g"], "id", "text", 2, fit=fit).count() == 2


def test_shared_answer_is_parsed_once(spark):
    """A hundred rows of one prompt: the answer is read per request; unanswered rows as before."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parse(output):
        seen.add(output is not None)
        return "none" if output is None else output.upper()

    rows = spark.range(100).withColumn("p", F.when(F.col("id") < 90, "said").otherwise("silent"))
    ask = asking.from_column(lambda p: F.when(p == "said", "ok"))
    got = asking.ask_column(rows, F.col("p"), "a", ask, parse, raw="raw").collect()
    assert sorted((r["a"], r["raw"]) for r in got) == [("OK", "ok")] * 90 + [("none", None)] * 10
    assert 0 < seen.value < 10


def test_one_split_is_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert scale.spread(spark.range(0, 100, 1, cores)).rdd.getNumPartitions() >= 4 * cores


def test_partitions_follow_the_input(spark, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    monkeypatch.setitem(session._INPUT_MB, "big", 700)
    session.dealt_by_size(spark, "big")
    assert spark.conf.get(name) == "700"
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_adjacency_meets_numbers(spark, monkeypatch):
    """Texts of adjacent DWAs come from numbers: tasks without a title, large ones and null DWAs included."""
    from gaugeworks.operators import hierarchy

    edges = [("t", f"k{i // 3}", f"d{i % 7}") for i in range(30)] + [(None, "k", f"d{i}") for i in range(9)]
    edges += [("k", None, "x"), ("t", "n", None), ("t", "m", "alone")]
    table = spark.createDataFrame(edges, "title string, task string, dwa string")
    near = {}
    for t, k, d in edges:
        near.setdefault(d, set()).update(e for t2, k2, e in edges if (t2, k2) == (t, k) and None not in (d, e) and d != e)
    want = {d: "\n\nno\n" + "\n".join(f"- {e}" for e in sorted(x)) if x else "" for d, x in near.items()}
    for small, names in ((64, 100), (2, 100), (64, 0)):
        monkeypatch.setattr(hierarchy, "SMALL_TASK", small)
        monkeypatch.setattr(hierarchy, "BROADCAST_NAMES", names)
        out = hierarchy.adjacent_contrast(table, prompt="no\n{unrelated}", criteria="c")
        assert {r.dwa: r.does_not_include_prompt for r in out.collect()} == want
        pairs = hierarchy.adjacent_dwas(table).collect()
        assert sorted(map(tuple, pairs)) == sorted((d, e) for d, x in near.items() for e in x)
