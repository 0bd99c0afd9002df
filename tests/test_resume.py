import json

from gaugeworks.operators import exchange
from gaugeworks.schemas import RESPONSE
from gaugeworks.streaming import results, resume
from pyspark.sql import functions as F


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def answer(request, attempt, output, tokens=400, model="m"):
    return {"request_hash": request, "attempt": attempt, "model": model, "output": output, "total_tokens": tokens}


def test_stream_stopped_between_files_gives_the_batch_result(spark, tmp_path):
    """Attempts out of order, repeated and missing ones; the query restarts for every file."""
    source, table, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    valid = F.col("output").isNotNull()
    files = [
        [answer("a", 1, "second"), answer("b", 0, "ok"), answer("c", 0, None)],
        [answer("a", 0, None), answer("b", 0, "ok"), answer("c", 1, "later"), answer("d", 2, "gap")],
        [answer("e", 0, "new"), answer("a", 2, "third"), answer("f", 0, None)],
        [answer("g", 0, "last", 50_000)],
    ]
    for k, rows in enumerate(files):
        lines(source / f"{k}.json", rows)
        # the tokens stand for the time of arrival; with the last file the watermark passes request d
        stream = results.responses(spark, str(source)).withColumn("at", F.timestamp_seconds("total_tokens"))
        stream = resume.first_valid_stream(stream, valid, arrived="at", late="1 hour")
        results.collect_results(stream, table, point).awaitTermination()
    batch = exchange.first_valid(spark.read.schema(RESPONSE).json(str(source)), valid)
    want = {(r["request_hash"], r["attempt"], r["output"]) for r in batch.collect()}
    got = [(r["request_hash"], r["attempt"], r["output"]) for r in spark.read.parquet(table).collect()]
    assert sorted(got) == sorted(want) and ("d", 2, "gap") in want


def test_milestones_over_restarts(spark, tmp_path):
    source, table, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(4):
        lines(source / f"{k}.json", [answer(f"r{k}{j}", 0, "x", 300, f"m{j % 2}") for j in range(4)])
        stream = resume.milestone_stream(results.responses(spark, str(source)), size=1_000)
        results.collect_results(stream, table, point).awaitTermination()
    usage = exchange.token_usage(spark.read.schema(RESPONSE).json(str(source)), milestone=1_000).collect()
    last = {}
    for r in spark.read.parquet(table).collect():
        last[r["model"]] = max(last.get(r["model"], 0), r["milestone"])
    assert last == {r["model"]: r["milestones"] for r in usage} == {"m0": 2, "m1": 2}
