"""Categorisation and quality steps of a filtering round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import templates
from ..operators import rounds
from .asking import Ask, ask_column


def _columns(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


def drop_requests(df: DataFrame, template: str, ask: Ask, *, text: str = "instance_text_human_only", out: str = "filtered_requests") -> DataFrame:
    """Leave out the user turns an answer lists by number."""
    split = df.withColumn("__turns", C.split_turns(text))
    columns = _columns(df) | {"numbered_instance_text_human_only": C.number_turns("__turns")}
    asked = ask_column(split, templates.fill(template, columns), "__drop", ask, L.index_list)
    return asked.withColumn(out, C.drop_turns("__turns", "__drop")).drop("__turns", "__drop")


def categorise(
    df: DataFrame,
    classify_template: str,
    ask: Ask,
    *,
    filter_template: str | None = None,
    summary_template: str | None = None,
    vote: str = "pred_choice",
    trial: int = 1,
) -> DataFrame:
    """Optional request filter, optional summary, then the multiple-choice answer.

    The summary prompt sees the filtered requests when there are any; the
    classification prompt sees the summary.
    """
    if filter_template is not None:
        df = drop_requests(df, filter_template, ask)
        df = df.withColumn("instance_text_human_only", F.col("filtered_requests"))
    if summary_template is not None:
        df = ask_column(
            df, templates.fill(summary_template, _columns(df)), "summ_instance_text", ask,
            lambda o: L.tag(o, "answer"), trial=trial,
        )
    out = ask_column(df, templates.fill(classify_template, _columns(df)), vote, ask, L.mcq, raw="__raw", trial=trial)
    return out.withColumn("thinking", L.tag("__raw", "thinking")).drop("__raw")


def categorisation_step(df: DataFrame, votes: list[str], method: str = "ABC") -> DataFrame:
    return df.withColumn("pred_keep", rounds.category_keep(F.array(*votes), method))


def homework_step(df: DataFrame, template: str, ask: Ask) -> DataFrame:
    """Kept unless the answer says homework."""
    out = ask_column(
        df, templates.fill(template, _columns(df)), "hw_answer", ask,
        lambda o: L.choice_tag(o, "answer", ["Yes", "No"]),
    )
    return out.withColumn("is_hw", L.homework_flag("hw_answer")).withColumn("pred_keep", ~F.col("is_hw"))


def quality_step(df: DataFrame, prompts: list[tuple[str, str, bool]], ask: Ask, *, text: str = "instance_text") -> DataFrame:
    """Kept when no prompt (name, template, yes_is_bad) flags low quality."""
    flags = []
    for name, template, yes_is_bad in prompts:
        answer = f"answer_{name}"
        df = ask_column(
            df, templates.fill(template, {"input_text": F.col(text)}), answer, ask,
            lambda o: F.nullif(L.choice_tag(o, "answer", ["Yes", "No"]), F.lit("")), prompt_name=name,
        )
        flags.append(L.quality_flag(answer, yes_is_bad=yes_is_bad))
    low = reduce(lambda a, b: a | b, flags)
    return df.withColumn("is_lq", low).withColumn("pred_keep", ~F.col("is_lq"))


def load_candidates(
    pairs: DataFrame, *, filters: list[DataFrame] = (), k_start: int, k_stop: int, preds: DataFrame | None = None,
    steps: list[str] = (), keys: list[str] = rounds.PAIR_KEY, category: list[str] = rounds.CATEGORY,
) -> DataFrame:
    """Filters (all of them), rank slice, survivors of the round so far."""
    out = rounds.semi_filter(pairs, *filters)
    out = rounds.k_range(out, k_start, k_stop, keys=category, ties=[k for k in keys if k not in category])
    return out if preds is None else rounds.survivors(out, preds, list(steps), keys=keys)
