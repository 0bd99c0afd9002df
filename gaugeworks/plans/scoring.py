"""Exposure scoring of tasks from examples."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import templates
from ..operators import diversity
from ..operators import exposure as E
from ..operators.scale import slice_of
from ..session import discard, materialised
from .asking import Ask, ask_column

SLICE_ROWS = 1_000_000  # examples of a slice of the tasks
MOST_SLICES = 8

PARSERS = {
    "original": L.exposure_answer,
    "new": L.letter_answer,
    "synthetic": L.letter_answer,
    "residual": lambda o: L.letter_answer(o, "C"),
    "residual_relabel": L.letter_answer,
}


def prompt_table(
    retrieved: DataFrame,
    task_space: DataFrame,
    *,
    id_col: str,
    prompt_ret: str,
    prompt_zs: str | None = None,
    edges: DataFrame | None = None,
    use_task: bool = True,
    max_examples: int = E.MAX_EXAMPLES,
    seed: int = 0,
    diverse_k: int | None = None,
    text: str | None = None,
    style: str = "plain",
    min_coverage: float | None = None,
    other_cols: list[str] = (),
    drop_missing: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Diverse rows, examples per task and per activity, prompt with fallback.

    With diverse rows or activities the tasks are taken in slices, so that the shuffles of one
    slice at a time are on disk; ``keep`` names the columns that are wanted of the result.
    """
    sampled = partial(E.sampled_examples, id_col=id_col, n=max_examples, seed=seed)

    def filled(table):
        out = E.prompt_with_fallback(
            table, prompt_ret=prompt_ret, prompt_zs=prompt_zs, style=style, other_cols=other_cols, drop_missing=drop_missing,
        )
        return out.select(*keep) if keep else out

    if diverse_k is None and edges is None:
        by_task = sampled(retrieved) if use_task else None
        return filled(E.retrieval_table(task_space, by_task, None, other_cols=other_cols, min_coverage=min_coverage))
    n = max(1, min(MOST_SLICES, -(-retrieved.count() // SLICE_ROWS)))

    if diverse_k is None:
        rows = [slice_of(retrieved, E.TASK, n, i) for i in range(n)]
    else:
        columns = dict.fromkeys([*E.TASK, id_col, text, "convo_subset", "response", *(["dwa"] if edges is not None else [])])
        rows = diversity.diverse_parts(retrieved.select(*columns), E.TASK, id_col, text, diverse_k, n)
    retrieved = reduce(DataFrame.unionAll, rows)
    found = retrieved.filter(F.col("response").isNotNull() & F.lit(max_examples > 0)).select(*E.TASK).distinct() if use_task else None
    tasks = materialised(E.covered_tasks(task_space, found, other_cols=other_cols, min_coverage=min_coverage), free=True)
    numbered = None if edges is None else E.numbered_examples(retrieved, id_col=id_col, n=max_examples, seed=seed)
    prompts = []
    for i in range(n):
        by_task = sampled(rows[i]) if use_task else None
        by_dwa = None if edges is None else E.linked_examples(numbered, slice_of(edges, E.TASK, n, i), n=max_examples)
        prompts.append(materialised(filled(E.with_examples(slice_of(tasks, E.TASK, n, i), by_task, by_dwa)), free=True))
        if diverse_k is not None:
            discard(rows[i])
    return reduce(DataFrame.unionAll, prompts)


def score_prompts(table: DataFrame, taxonomy: str, ask: Ask, *, prompt: str = "prompt", valid: bool = True, **params) -> DataFrame:
    """Ask, read the label, map it to its number."""
    parse = PARSERS[taxonomy]
    out = ask_column(
        table, F.col(prompt), "label", ask, parse,
        valid=(lambda o: parse(o).isNotNull()) if valid else None, **params,
    )
    return out.withColumn("beta", L.score("label", taxonomy))


def score_zero_shot(tasks: DataFrame, template: str, taxonomy: str, ask: Ask) -> DataFrame:
    columns = {"occupation": F.col("category_occ"), "task": F.col("category_task")}
    table = tasks.select(*E.TASK).distinct().withColumn("prompt", templates.fill(template, columns))
    return score_prompts(table, taxonomy, ask)


def score_double(table: DataFrame, ask: Ask, *, prompt: str = "prompt") -> DataFrame:
    """Two labels in one answer: as observed, and with a perfect model."""
    out = ask_column(table, F.col(prompt), "__d", ask, L.double_answer)
    for side in ("observed", "perfect"):
        out = out.withColumn(side, F.col(f"__d.{side}")).withColumn(f"beta_{side}", L.score(side, "new"))
    return out.drop("__d")


def score_residual(rows: DataFrame, few_shot: list[tuple[str, str]], template: str, ask: Ask, *, relabel: bool = False) -> DataFrame:
    """Residual score against a reference label, with few-shot turns in front."""
    turns = [*few_shot, ("user", template)]
    prompt = templates.fill_turns(turns, {c: F.col(c) for c in rows.columns})
    table = rows.withColumn("prompt", prompt)
    return score_prompts(table, "residual_relabel" if relabel else "residual", ask)


def summarise(df: DataFrame, template: str, ask: Ask) -> DataFrame:
    """Replace each conversation by a one-turn summary of its first request."""
    out = ask_column(df, E.summary_requests(df, template), "request_summary", ask, L.summary)
    return E.with_summary(out)
