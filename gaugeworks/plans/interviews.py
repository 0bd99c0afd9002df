"""Interviews: response turns one after the other, activity scoring with retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import templates
from ..operators import hierarchy as H
from ..operators.scale import skew_join, spread
from ..session import materialised
from .asking import Ask, ask_column
from .synthesis import explode_backgrounds, generate_backgrounds

RETRIES = 4

RETRY_TEMPLATE = (
    "The last answer to the prompt below could not be read ({error}, attempt {attempt}).\n"
    "Last answer:\n```\n{invalid}\n```\n"
    "Answer again in the requested structure and keep all facts and numbers.\n\n{base}"
)


def response_turns(messages: list[dict]) -> list[int]:
    """Indices of the assistant turns that are to be answered."""
    return [
        i
        for i, m in enumerate(messages)
        if m["role"] == "assistant" and isinstance(m["content"], dict) and "system" in m["content"]
    ]


def turn_prompt(messages: list[dict], index: int, columns: dict[str, Column]) -> Column:
    """System prompt of the response turn, then all earlier turns.

    Earlier response turns are filled with their results.
    """
    turns = [("system", messages[index]["content"]["system"])]
    for i, m in enumerate(messages[:index]):
        text = m["content"] if isinstance(m["content"], str) else "{_result_%d}" % i
        turns.append((m["role"], text))
    return templates.fill_turns(turns, columns)


def run_interview(
    df: DataFrame, messages: list[dict], ask: Ask, *, parser=None, start_from: int | None = None, **params
) -> DataFrame:
    """Answer each response turn in order, with one written table between turns.

    ``start_from`` continues at a turn of a table that has the earlier results.
    """
    turns = response_turns(messages)
    if not turns:
        raise ValueError("no response turn in the messages")
    if start_from is not None:
        if start_from not in turns:
            raise ValueError(f"{start_from} is not one of the response turns {turns}")
        turns = [i for i in turns if i >= start_from]
    for i in turns:
        prompt = turn_prompt(messages, i, {c: F.col(c) for c in df.columns})
        df = materialised(ask_column(df, prompt, f"_result_{i}", ask, parser, **params))
    return df


def match_activities(
    df: DataFrame, tasks: DataFrame | None, template: str, result: str, ask: Ask, *, output: str = "matches", **params
) -> DataFrame:
    """Ask which activities of an interview belong to the task being scored."""
    if tasks is not None:
        df = df.join(H.occupation_tasks(tasks), "category_occ", "left").withColumn(
            "occupation_tasks",
            F.coalesce(
                "occupation_tasks",
                F.raise_error(F.concat(F.lit("no tasks for occupation "), F.coalesce("category_occ", F.lit("NULL")))),
            ),
        )
    columns = {c: F.col(c) for c in df.columns} | {"result": L.clean_result(result)}
    return ask_column(df.withColumn("__base", templates.fill(template, columns)), F.col("__base"), output, ask, **params)


def score_with_retries(
    df: DataFrame, ask: Ask, *, key: str, output: str = "matches", base: str = "__base", retries: int = RETRIES,
    taxonomy: str = "interview_span", **params,
) -> DataFrame:
    """Bucket the activity output of each row, asking again for unreadable ones.

    Readable rows are done; the others are asked with the error text until the
    retries are used up and then keep a NULL score.
    """
    done = None
    rest = spread(df)
    for attempt in range(retries + 1):
        parsed = materialised(rest.withColumn("__p", L.activities(output)).withColumn(
            "score", L.span_bucket("__p.activities")
        ).withColumn(
            "n_unmatched", F.when(F.col("__p.error").isNull(), L.n_unmatched("__p.activities"))
        ).withColumn(
            "parse_error",
            F.coalesce("__p.error", F.when(F.col("score").isNull(), F.lit("negative ratio"))),
        ).drop("__p").withColumn("attempt", F.lit(attempt)))
        good = parsed.filter(F.col("parse_error").isNull())
        bad = parsed.filter(F.col("parse_error").isNotNull())
        done = good if done is None else done.unionByName(good)
        if attempt == retries or bad.isEmpty():
            done = done.unionByName(bad)
            break
        prompt = templates.fill(RETRY_TEMPLATE, {
            "error": F.col("parse_error"), "attempt": F.lit(attempt + 1),
            "invalid": F.col(output), "base": F.col(base),
        })
        asked = ask_column(bad, prompt, "__again", ask, **params)
        rest = asked.drop("score", "n_unmatched", "parse_error", "attempt", output).withColumnRenamed(
            "__again", output
        )
    return done.withColumn("beta", L.score("score", taxonomy))


def categorise_result(
    df: DataFrame, template: str, result: str, ask: Ask, *, taxonomy: str, **params
) -> DataFrame:
    """Label an interview result with one of the taxonomy's labels and its number."""
    columns = {c: F.col(c) for c in df.columns} | {"result": L.clean_result(result)}
    labels = list(L.SCORE_MAPS[taxonomy])
    out = ask_column(
        df, templates.fill(template, columns), "score", ask, lambda o: L.allowed_answer(o, labels), **params
    )
    return out.withColumn("beta", L.score("score", taxonomy))


def run_interview_scoring(
    df: DataFrame, messages: list[dict], ask: Ask, *, key: str, match_template: str | None = None,
    tasks: DataFrame | None = None, manual: bool = False, categorise_template: str | None = None,
    taxonomy: str = "interview_span", start_from: int | None = None, skip_interview: bool = False,
) -> DataFrame:
    """Interview, optional activity matching, then manual bucket or category label."""
    if not skip_interview:
        df = run_interview(df, messages, ask, start_from=start_from)
    result = f"_result_{len(messages) - 1}"
    if result not in df.columns:
        raise ValueError(f"no column {result} for the last response turn")
    if match_template is not None:
        df = match_activities(df, tasks, match_template, result, ask)
        result = "matches"
    if manual:
        return score_with_retries(df, ask, key=key, taxonomy=taxonomy).drop("__base")
    return categorise_result(df.drop("__base"), categorise_template, result, ask, taxonomy=taxonomy)


def score_backgrounds(
    rows: DataFrame, keys: list[str], template: str, background_ask: Ask, messages: list[dict], ask: Ask, *,
    key: str, loops: int = 1, first_k: int | None = None, **options,
) -> DataFrame:
    """Interview and score every row once per respondent background of its task.

    Backgrounds are asked for once per task.  A task without any is an error, since
    its rows would be missing from the scores.
    """
    tasks = generate_backgrounds(rows.select(*keys).distinct(), template, background_ask, loops=loops, first_k=first_k)
    people = tasks.withColumn(
        "backgrounds",
        F.when(F.size("backgrounds") > 0, F.col("backgrounds")).otherwise(
            F.raise_error(F.concat(F.lit("no background for "), F.to_json(F.struct(*keys))))
        ),
    )
    asked = skew_join(rows, explode_backgrounds(people), keys)
    return run_interview_scoring(asked, messages, ask, key=key, **options)


def responses_per_model(df: DataFrame, models: list[str], ask: Ask, convo: str = "convo_subset") -> DataFrame:
    """Response of every model to each conversation, one row per model."""
    rows = df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    # the model is part of the request
    marked = F.concat(F.array(C.turn("system", F.concat(F.lit("model: "), F.col("model")))), C.lint(convo))
    return ask_column(rows, marked, "response", ask)
