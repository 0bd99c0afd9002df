"""Examples per task, prompt tables with fallback, coverage, exposure summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import templates
from ..session import discard, materialised
from .scale import first_per_key, ordered_lists, positions, skew_join, stable_order, top_per_key, with_group_stats

TASK = ["category_occ", "category_task"]
MIN_COVERAGE = 0.3
MAX_EXAMPLES = 10


def task_examples(
    df: DataFrame, *, order: list[str], keys: list[str] = TASK, convo="convo_subset", response="response",
) -> DataFrame:
    """All example pairs per key without missing outputs, one struct list."""
    pairs = df.filter(F.col(response).isNotNull())
    entry = F.struct(F.col(convo).alias("input"), F.col(response).alias("output"))
    return ordered_lists(pairs, keys, order, {"examples": entry})


def _sample_order(seed: int, id_col: str) -> list[Column]:
    """Seeded hash order; half as wide in a shuffle as the hex digits, whose order it has."""
    return [F.unhex(stable_order(seed, id_col)), F.col(id_col)]


def sampled_examples(
    df: DataFrame, *, id_col: str, n: int = MAX_EXAMPLES, seed: int = 0, keys: list[str] = TASK,
    convo="convo_subset", response="response",
) -> DataFrame:
    """Up to ``n`` examples per key in seeded hash order, as one bounded list.

    The limit is applied before the lists are collected, so a task with very
    many examples sends n rows per map task.
    """
    pairs = df.filter(F.col(response).isNotNull())
    order = _sample_order(seed, id_col)
    kept = top_per_key(pairs, keys, order, n, "__r")
    entry = F.struct(
        F.col("__r"), F.struct(F.col(convo).alias("input"), F.col(response).alias("output")).alias("e")
    )
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__l")).select(
        *keys, F.col("__l.e").alias("examples")
    )


def sampled_examples_by_dwa(
    df: DataFrame, edges: DataFrame, *, id_col: str, n: int = MAX_EXAMPLES, seed: int = 0,
    dwa: str = "dwa", convo="convo_subset", response="response",
) -> DataFrame:
    """Examples of all activities of a task, flattened and sampled.

    The hash order depends on the example alone, so the best n per activity hold
    the best n per task: each edge carries the numbers of at most n examples.
    """
    numbered = numbered_examples(df, id_col=id_col, n=n, seed=seed, dwa=dwa, convo=convo, response=response)
    return linked_examples(numbered, edges, n=n, dwa=dwa)


def numbered_examples(
    df: DataFrame, *, id_col: str, n: int = MAX_EXAMPLES, seed: int = 0, dwa: str = "dwa", convo="convo_subset", response="response",
) -> DataFrame:
    """Up to ``n`` examples ``e`` per activity, numbered (``__p``) in their seeded hash order."""
    pairs = df.filter(F.col(response).isNotNull())
    order = _sample_order(seed, id_col)
    per_dwa = top_per_key(pairs.select(dwa, id_col, convo, response), [dwa], order, n, "__r").drop("__r")
    # the few examples left are numbered in their order: edges and tasks carry numbers only
    entry = F.struct(F.col(convo).alias("input"), F.col(response).alias("output"))
    per_dwa = materialised(per_dwa, free=True)
    out = materialised(positions(per_dwa, [], [*order, F.col(dwa)], "__p").select(dwa, "__p", entry.alias("e")), free=True)
    discard(per_dwa)
    return out


def linked_examples(numbered: DataFrame, edges: DataFrame, *, n: int = MAX_EXAMPLES, dwa: str = "dwa") -> DataFrame:
    """Up to ``n`` of the numbered examples per task over all activities its edges name."""
    packed = numbered.groupBy(dwa).agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
    links = materialised(edges.select(*TASK, dwa).distinct(), free=True)
    linked = skew_join(links, packed, [dwa]).select(*TASK, F.explode("__ps").alias("__p"))
    # counted and joined below: ranked once
    kept = materialised(top_per_key(linked, TASK, [F.col("__p")], n, "__r"), free=True)
    discard(links)
    # an example is that of many tasks
    found = skew_join(kept, numbered.select("__p", "e"), ["__p"])
    return found.groupBy(*TASK).agg(F.sort_array(F.collect_list(F.struct("__r", "e"))).alias("__l")).select(
        *TASK, F.col("__l.e").alias("examples")
    )


def dwa_example_counts(df: DataFrame, edges: DataFrame, *, dwa: str = "dwa") -> DataFrame:
    """Number of flattened examples per task over all its activities."""
    per_dwa = df.filter(F.col("response").isNotNull()).groupBy(dwa).agg(F.count(F.lit(1)).alias("__n"))
    linked = skew_join(edges.select(*TASK, dwa).distinct(), per_dwa, [dwa])
    return linked.groupBy(*TASK).agg(F.sum("__n").alias("n_examples"))


def retrieval_table(
    task_space: DataFrame,
    by_task: DataFrame | None,
    by_dwa: DataFrame | None,
    *,
    other_cols: list[str] = (),
    min_coverage: float | None = None,
) -> DataFrame:
    """Distinct task space with the example lists of the task and of its activities."""
    return with_examples(covered_tasks(task_space, by_task, other_cols=other_cols, min_coverage=min_coverage), by_task, by_dwa)


def covered_tasks(
    task_space: DataFrame, by_task: DataFrame | None, *, other_cols: list[str] = (), min_coverage: float | None = None,
) -> DataFrame:
    """Distinct task space, with a least coverage only the occupations that reach it.

    Coverage asks whether a task has examples; the examples themselves are not moved for it.
    """
    missing = set(other_cols) - set(task_space.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are not in the task space")
    if min_coverage is not None and by_task is None:
        raise ValueError("the coverage filter needs task examples")
    out = task_space.select(*TASK, *other_cols).distinct()
    if min_coverage is None:
        return out
    has = materialised(out.join(by_task.select(*TASK, F.lit(1).alias("__has")), TASK, "left"), free=True)
    return filter_by_coverage(add_coverage(has, evidence="__has"), min_coverage).drop("__has")


def with_examples(tasks: DataFrame, by_task: DataFrame | None, by_dwa: DataFrame | None) -> DataFrame:
    """The example lists of each task and of its activities."""

    def attach(table, side, name):
        if side is None:
            return table.withColumn(
                name, F.lit(None).cast("array<struct<input:array<struct<role:string,content:string>>,output:string>>")
            )
        return table.join(side.withColumnRenamed("examples", name), TASK, "left")

    return attach(attach(tasks, by_task, "examples_by_task"), by_dwa, "examples_by_dwa")


def prompt_with_fallback(
    table: DataFrame,
    *,
    prompt_ret: str,
    prompt_zs: str | None,
    style: str = "plain",
    other_cols: list[str] = (),
    drop_missing: bool = False,
) -> DataFrame:
    """Prompt from the task's examples, else its activities', else zero-shot, else none."""
    base = {"occupation": F.col("category_occ"), "task": F.col("category_task")}
    base |= {c: F.col(c) for c in other_cols}

    def filled(examples):
        return templates.fill(prompt_ret, {**base, "examples_strs": C.examples_text(examples, style=style)})

    prompt = F.when(F.col("examples_by_task").isNotNull(), filled("examples_by_task")).when(
        F.col("examples_by_dwa").isNotNull(), filled("examples_by_dwa")
    )
    if prompt_zs is not None:
        prompt = prompt.otherwise(templates.fill(prompt_zs, base))
    method = (
        F.when(F.col("examples_by_task").isNotNull(), "task")
        .when(F.col("examples_by_dwa").isNotNull(), "dwa")
        .otherwise("zs" if prompt_zs is not None else "none")
    )
    out = table.withColumn("prompt", prompt).withColumn("method", method)
    return out.filter(F.col("prompt").isNotNull()) if drop_missing else out


def add_coverage(df: DataFrame, *, occ: str = "category_occ", evidence: str = "model_inputs") -> DataFrame:
    """Share, count and total of rows with evidence per occupation, on every row."""
    has = F.col(evidence).isNotNull().cast("int")
    return with_group_stats(
        df, [occ],
        [F.avg(has).alias("coverage"), F.sum(has).alias("n_covered"), F.count(F.lit(1)).alias("n_tasks")],
    )


def filter_by_coverage(df: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    return df.filter(F.col("coverage") >= min_coverage)


def occupation_exposure(df: DataFrame, *, occ: str = "category_occ", score: str, beta: str, unmatched: str) -> DataFrame:
    """Mean beta and mean unmatched activities of the fully scored occupations."""
    return (
        df.groupBy(occ)
        .agg(
            F.avg(beta).alias("exposure"),
            F.avg(unmatched).alias("mean_unmatched"),
            F.bool_and(F.col(score).isNotNull()).alias("__done"),
        )
        .filter("__done")
        .drop("__done")
    )


def residual_input(
    rows: DataFrame, task_space: DataFrame, reference: DataFrame, *, order: list[str], forced: str | None = None
) -> DataFrame:
    """Rows of the task space with their reference label.

    The first label per key counts; E1 and E2 change places, other labels drop
    out.  A forced label replaces all of them.
    """
    kept = skew_join(rows, task_space.select(*TASK).distinct(), TASK, "left_semi")
    if forced is not None:
        return kept.withColumn("reference_label", F.lit(forced))
    first = first_per_key(reference, TASK, [F.col(o) for o in order]).select(*TASK, "reference_label")
    swapped = L.lookup("reference_label", {"E0": "E0", "E1": "E2", "E2": "E1"})
    return (
        skew_join(kept, first, TASK, "left")
        .withColumn("reference_label", swapped)
        .filter(F.col("reference_label").isNotNull())
    )


def _score_label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def score_counts(df: DataFrame, score: str, model: str) -> DataFrame:
    """Count per score and model; missing scores are counted as "None"."""
    return df.groupBy(
        _score_label(F.col(score)).alias("score"), _score_label(F.col(model)).alias("model")
    ).agg(F.count(F.lit(1)).alias("n"))


def score_count_pivot(df: DataFrame, score: str, model: str, models: list[str]) -> DataFrame:
    """Zero-filled table of scores by model: numbers in order, then other labels."""
    wide = score_counts(df, score, model).groupBy("score").pivot("model", sorted(models)).sum("n").fillna(0)
    number = F.col("score").try_cast("double")
    return wide.orderBy(number.isNull(), number, "score")


def task_id_column(df: DataFrame, candidates: list[str] = ("task_id", "category_task", "task")) -> str:
    """First known task column a table has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return found


def scores_listing(df: DataFrame, *, occ: str = "category_occ", beta: str = "beta") -> DataFrame:
    task = task_id_column(df)
    return df.select(occ, task, beta).distinct().orderBy(occ, task, beta)


def summary_requests(df: DataFrame, template: str, convo: str = "convo_subset") -> Column:
    """Prompt asking for a summary of the first user turn."""
    return templates.fill(template, {"request": C.first_of_role(convo, "user")})


def with_summary(df: DataFrame, summary: str = "request_summary", convo: str = "convo_subset") -> DataFrame:
    """Rows with a summary, wrapped as a one-turn conversation."""
    return df.withColumn(convo, C.as_conversation(summary))
