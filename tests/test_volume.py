"""Rows that a query shuffles, and what its steps hold."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import diversity


@pytest.fixture()
def shuffled(spark):
    """Records that the stages write to a shuffle while a function runs."""

    def run(fn):
        sc = spark.sparkContext
        none = sc._gateway.new_array(sc._jvm.double, 0)

        def total():
            stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
            return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

        before = total()
        out = fn()
        return out, sum(n for stage, n in total().items() if stage not in before)

    return run


def test_diverse_picks_shuffle_no_row_per_term(spark, shuffled):
    """300 texts of 60 words in two groups: far fewer rows are dealt than there are terms."""
    words = F.expr("transform(sequence(1, 60), i -> concat('w', pmod(xxhash64(id, i), 500)))")
    docs = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.concat_ws(" ", words).alias("text"))
    picks, rows = shuffled(lambda: diversity.diverse_rows(docs, ["g"], "id", "text", 3).collect())
    assert len(picks) == 6 and rows < 10_000


def test_turns_are_picked_without_conversations(spark, tmp_path, shuffled):
    """A category's members are found from the number of user turns; each vote is picked once."""
    from gaugeworks.catalog import queries

    spark.range(900).selectExpr("id event_id", "id % 30 user_id").write.parquet(f"{tmp_path}/events.parquet")
    turns = spark.range(30).selectExpr("id conv_id", "explode(sequence(0, 39)) turn").selectExpr(
        "conv_id", "turn", "if(turn % 2 = 0, 'user', 'assistant') role", "repeat('x', 50) text"
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    members, rows = shuffled(lambda: queries()["category_members"](spark, str(tmp_path)).collect())
    want = {(f"dwa {i % 40}", i % 30) for i in range(900) if i % 5}
    assert {(r["dwa"], r["instance_idx"]) for r in members} == want and len(members) == len(want)
    assert rows < 3_000


def test_examples_reach_tasks_as_numbers(spark, monkeypatch):
    """Order strings and conversations are not carried by the edges: a task ranks numbers."""
    from gaugeworks.operators import exposure

    ranked = []
    top = exposure.top_per_key

    def seen(df, keys, *args):
        ranked.append((list(keys), df.columns))
        return top(df, keys, *args)

    monkeypatch.setattr(exposure, "top_per_key", seen)
    rows = [(f"o{i % 4}", f"t{i % 4}", f"d{i % 3}", f"x{i}", f"r{i}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "category_occ string, category_task string, dwa string, id string, response string")
    df = df.withColumn("convo_subset", F.expr("array(named_struct('role', 'user', 'content', id))"))
    got = {r["category_occ"]: [e["output"] for e in r["examples"]] for r in exposure.sampled_examples_by_dwa(df, df, id_col="id", n=3).collect()}
    order = {r["id"]: r["h"] for r in df.select("id", exposure.stable_order(0, "id").alias("h")).collect()}
    for occ in {r[0] for r in rows}:
        dwas = {r[2] for r in rows if r[0] == occ}
        want = sorted((r for r in rows if r[2] in dwas and r[4]), key=lambda r: (order[r[3]], r[3]))[:3]
        assert got[occ] == [r[4] for r in want]
    assert [c for keys, c in ranked if keys == exposure.TASK] == [[*exposure.TASK, "__p"]]


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in map(found.apply, range(found.size())) if f.getName().startswith("shuffle_")}


def left_on_disk(spark, before):
    """Shuffle files that are still there after some seconds; they are removed in the background."""
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_prompt_table_in_slices(spark, monkeypatch):
    """Slices give the prompts of the whole table, texts weighed over all of it; no shuffle stays on disk."""
    from gaugeworks.plans import scoring

    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [
        (f"o{i % 3}", f"t{i % 7}" if i % 20 else None, f"d{i % 4}", f"x{i:02}", f"r{i}" if i % 6 else None,
         "same" if i % 7 < 3 else " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 5)))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "category_occ string, category_task string, dwa string, id string, response string, text string")
    df = df.withColumn("convo_subset", F.expr("array(named_struct('role', 'user', 'content', id))"))

    def prompts(**other):
        out = scoring.prompt_table(
            df, df, id_col="id", prompt_ret="{task} {examples_strs}", prompt_zs="{task}", edges=df.filter("dwa <> 'd1'"),
            max_examples=2, seed=3, diverse_k=3, text="text", min_coverage=0.1, **other,
        )
        return out, {(r["category_occ"], r["category_task"], r["method"], r["prompt"]) for r in out.collect()}

    table, whole = prompts()
    assert len(whole) == 24 and {"coverage", "examples_by_task", "examples_by_dwa"} <= set(table.columns)
    monkeypatch.setattr(scoring, "SLICE_ROWS", 30)
    _, sliced = prompts(keep=["category_occ", "category_task", "method", "prompt"])
    assert sliced == whole
    before = shuffle_files(spark)
    scoring.prompt_table(
        df, df, id_col="id", prompt_ret="{task} {examples_strs}", prompt_zs="{task}", edges=df,
        max_examples=2, diverse_k=3, text="category_task", min_coverage=0.1,
    )
    assert not left_on_disk(spark, before)


def test_chunks_of_texts_are_not_shuffled_again(spark, monkeypatch):
    """Texts of many chunks: no shuffle stays on disk, and what was written is joined where it lies."""
    monkeypatch.setattr(diversity, "GROUP_TERMS", 2_000)
    monkeypatch.setattr(diversity, "_BLOCK_TERMS", 1_000)
    words = F.expr("transform(sequence(1, 60), i -> concat('w', pmod(xxhash64(id, i), 500)))")
    docs = spark.range(300).select("id", (F.col("id") % 2).alias("g"), F.concat_ws(" ", words).alias("text"))
    joined = []
    attached = diversity._attached

    def seen(chunks, pooled, **names):
        out = attached(chunks, pooled, **names)
        joined.append((len(pooled), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(diversity, "_attached", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffle_files(spark)
    try:
        out = diversity.diverse_rows(docs, ["g"], "id", "text", 3)
        assert not left_on_disk(spark, before)
        assert sorted((r["g"], r["pick"]) for r in out.collect()) == [(g, i) for g in (0, 1) for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joined) == 5 and {n for n, _ in joined} == {1, 3} and not any("Exchange" in plan for _, plan in joined)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("table_")]


def test_numbers_are_packed_exactly():
    for values in (np.array([], np.int64), np.array([-(1 << 63), -5, 0, 7, (1 << 63) - 1])):
        assert (diversity._unpacked(diversity._packed(values)) == values).all()
        assert (diversity._unpacked_terms(diversity._packed_terms(values)) == values).all()
    floats = np.array([0.0, 0.1, -1e300, np.pi])
    assert (diversity._unpacked_parts([diversity._packed(floats), diversity._packed(floats[:0]), diversity._packed(floats)]) == np.tile(floats, 2)).all()
    assert len(diversity._packed(np.arange(100_000) % 7)) < 10_000
