"""Ways to answer requests, and one column step over them.

An ``ask`` function takes a table of distinct requests (request_hash, prompt)
and returns responses (request_hash, output, optionally attempt).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import exchange as X
from ..session import materialised

Ask = Callable[[DataFrame], DataFrame]


def from_table(responses: DataFrame) -> Ask:
    """Answer from known responses only; the rest stays unanswered."""
    return lambda requests: responses.join(
        requests.select("request_hash"), "request_hash", "left_semi"
    )


def from_function(responder) -> Ask:
    """Answer with a Python function inside Spark tasks; every request once."""
    return lambda requests: materialised(X.answer_pending(requests, responder))


def from_column(answer: Callable[[Column], Column]) -> Ask:
    """Answer with a column expression of the prompt (a stand-in for a model)."""
    return lambda requests: requests.select(
        "request_hash", F.lit(0).alias("attempt"), answer(F.col("prompt")).alias("output")
    )


def with_known(responses: DataFrame, ask: Ask) -> Ask:
    """Known responses first; only pending requests are asked."""

    def run(requests: DataFrame) -> DataFrame:
        known = from_table(responses)(requests)
        rest = requests.join(known.select("request_hash").distinct(), "request_hash", "left_anti")
        return known.unionByName(ask(rest), allowMissingColumns=True)

    return run


def ask_column(
    df: DataFrame,
    prompt: Column,
    target: str,
    ask: Ask,
    parser: Callable[[Column], Column] | None = None,
    *,
    valid: Callable[[Column], Column] | None = None,
    raw: str | None = None,
    **params,
) -> DataFrame:
    """Add a column with the parsed answer to a prompt column.

    Equal prompts are asked once.  A NULL prompt is not asked.  The lowest valid
    attempt counts; ``raw`` keeps the unparsed answer as well.
    """
    keyed = df.withColumn("__prompt", prompt).withColumn(
        "request_hash",
        F.when(F.col("__prompt").isNotNull(), X.request_hash("__prompt", **params)),
    )
    requests = (
        keyed.filter(F.col("request_hash").isNotNull())
        .groupBy("request_hash")
        .agg(F.first("__prompt").alias("prompt"))
    )
    ok = F.col("output").isNotNull()
    if valid is not None:
        ok = ok & F.coalesce(valid(F.col("output")), F.lit(False))
    answers = ask(requests)
    if "attempt" not in answers.columns:
        answers = answers.withColumn("attempt", F.lit(0))
    parse = parser or (lambda output: output)
    # parsed once per request, before the answer is joined to the rows that share it
    best = X.first_valid(answers, ok).select(
        "request_hash", F.col("output").alias("__output"), parse(F.col("output")).alias("__value"), F.lit(True).alias("__hit")
    )
    out = X.join_responses(keyed, best, ["__value", "__hit", *(["__output"] if raw is not None else [])])
    unanswered = parse(F.lit(None).cast(answers.schema["output"].dataType))
    out = out.withColumn(target, F.when(F.col("__hit"), F.col("__value")).otherwise(unanswered))
    if raw is not None:
        out = out.withColumn(raw, F.col("__output"))
    return out.drop("__prompt", "__output", "__value", "__hit", "request_hash")


def embed_column(df: DataFrame, text: Column, target: str, ask: Ask, **params) -> DataFrame:
    """Embed a text column: answers are JSON lists of numbers."""
    return ask_column(
        df, text, target, ask, lambda o: F.from_json(o, "array<float>"), kind="embedding", **params
    )
