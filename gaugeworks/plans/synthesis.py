"""Search for synthetic queries that pass verifiers, and their building blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import templates
from ..operators.scale import skew_join
from ..session import materialised
from .asking import Ask, ask_column

ROW = "__row_id"
# fixed values: levels of the search, in order
LEVELS = ("90%-100%", "80%", "70%", "60%", "50%", "40%", "30%", "20%", "10%")


def passed(df: DataFrame, answer: str, expected: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(answer) == expected, F.lit(False)))


def search(
    base: DataFrame,
    levels: list[str],
    generate: Callable[[DataFrame], DataFrame],
    verifiers: list[Callable[[DataFrame, str], DataFrame]],
    *,
    order: list[str],
    row_id: str = ROW,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified, not found and intermediate rows of the level-wise search.

    On each level queries are generated for the pending rows only and verified;
    the first passing one per row (by ``order``) is kept and the row leaves the
    pool.  Each level is one written table in which the kept rows are marked, so a
    level is never generated twice; what is kept and what is pending are read off
    these tables.  A verifier adds the boolean column it is told to.
    """
    if not verifiers:
        raise ValueError("the search needs a verifier")
    base = materialised(base)
    columns = [f"pass_{i}" for i in range(len(verifiers))]
    first = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("passed_all"), *[F.col(o) for o in order]))
    pending, seen = base, []
    for level in levels:
        made = generate(pending.withColumn("time_savings", F.lit(level))).filter(F.col("query").isNotNull())
        for verify, column in zip(verifiers, columns):
            made = verify(made, column)
        both = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in columns])
        marked = made.withColumn("passed_all", both).withColumn("__kept", F.col("passed_all") & (first == 1))
        seen.append(materialised(marked))
        done = reduce(DataFrame.union, [part.filter("__kept").select(row_id) for part in seen])
        pending = base.join(done, row_id, "left_anti")

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seen)
    return every.filter("__kept").drop("__kept"), pending, every.drop("__kept")


def generate_backgrounds(
    df: DataFrame, template: str, ask: Ask, *, loops: int = 1, first_k: int | None = None, **params
) -> DataFrame:
    """Respondent backgrounds of all loops in order, the first k kept."""
    columns = {c: F.col(c) for c in df.columns}
    prompt = templates.fill(template, columns)
    for i in range(loops):
        df = ask_column(df, prompt, f"__bg_{i}", ask, L.backgrounds, loop=i, **params)
    empty = F.array().cast(df.schema["__bg_0"].dataType)
    parts = F.concat(*[F.coalesce(f"__bg_{i}", empty) for i in range(loops)])
    if first_k is not None:
        parts = F.slice(parts, 1, first_k)
    # written once: exploding the list would read the answers several times
    return materialised(df.withColumn("backgrounds", parts).drop(*[f"__bg_{i}" for i in range(loops)]))


def explode_backgrounds(df: DataFrame) -> DataFrame:
    """One row per background with its fields as columns and its position."""
    rows = df.select("*", F.posexplode("backgrounds").alias("respondent_pos", "__b")).drop("backgrounds")
    return rows.select("*", "__b.*").drop("__b")


def with_backgrounds(rows: DataFrame, keys: list[str], template: str, ask: Ask, **params) -> DataFrame:
    """Each row once per background of its task, asked for once per task.

    The template uses the key columns; rows whose task got no background are left
    out, as there is nobody to interview.
    """
    tasks = generate_backgrounds(rows.select(*keys).distinct(), template, ask, **params)
    return skew_join(rows, explode_backgrounds(tasks), keys)


def generate_queries(
    df: DataFrame,
    turns: list[tuple[str, str]],
    ask: Ask,
    *,
    rewrites: list[tuple[int, str]] = (),
    require_code: bool = True,
    attachments: bool = False,
    **params,
) -> DataFrame:
    """Dialogue prompt per background, optional turn rewrites, parsed query columns."""
    df = df.withColumn("__turns", templates.fill_turns(turns, {c: F.col(c) for c in df.columns}))
    for index, template in rewrites:
        df = rewrite_turn(df, "__turns", index, template, ask)
    df = ask_column(df, F.col("__turns"), "__mail", ask, raw="__raw", **params)
    mail = L.email("__raw", require_code=require_code, trailing=attachments)
    df = df.withColumn("__m", mail).select("*", "__m.*")
    if attachments:
        df = df.withColumn("attachments_raw_xml", F.when(F.col("query").isNotNull(), L.attachments_xml("__raw")))
    return df.drop("__turns", "__mail", "__raw", "__m")


def rewrite_turn(df: DataFrame, turns: str, index: int, template: str, ask: Ask, **params) -> DataFrame:
    """Replace one dialogue turn by its rewritten version."""
    columns = {c: F.col(c) for c in df.columns if c != turns}
    columns["user_turn"] = F.get(F.col(turns), F.lit(index - 1))["content"]
    columns["assistant_turn"] = F.get(F.col(turns), F.lit(index))["content"]
    out = ask_column(df, templates.fill(template, columns), "__new", ask, **params)
    return out.withColumn(turns, C.replace_turn(turns, index, "__new")).drop("__new")


def rewrite_query(df: DataFrame, template: str, ask: Ask, query: str = "query", **params) -> DataFrame:
    prompt = templates.fill(template, {c: F.col(c) for c in df.columns})
    return ask_column(df, prompt, "__new", ask, L.ws_strip, **params).withColumn(query, F.col("__new")).drop("__new")


def add_references(df: DataFrame, template: str, ask: Ask, **params) -> DataFrame:
    """Reference texts for the rows that have attachment specifications."""
    df = df.withColumn("attachments_replaced_tags", L.reference_specs("attachments_raw_xml"))
    has = F.col("attachments_replaced_tags").isNotNull()
    prompt = F.when(has, templates.fill(template, {c: F.col(c) for c in df.columns}))
    out = ask_column(df, prompt, "reference_outputs", ask, L.generated_references, **params)
    joined = F.when(F.col("reference_outputs").isNotNull(), F.array_join("reference_outputs", "\n\n"))
    return out.withColumn("references_text", joined)


def query_with_references(query: str, references: list[tuple[str, str]], prefix: str = "## ") -> Column:
    """Query text followed by a headed section per filled reference column."""
    sections = [
        F.when(
            L.ws_strip(c) != "", F.concat(F.lit(f"{prefix}{header}\n"), L.ws_strip(c))
        )
        for c, header in references
    ]
    text = F.concat_ws("\n\n", F.col(query), *sections)
    return L.ws_strip(text) if references else F.col(query)


def prompt_verifier(
    template: str, ask: Ask, expected: str, *, references: list[tuple[str, str]] = (), **params
) -> Callable[[DataFrame, str], DataFrame]:
    """Verifier that asks about the query and compares the answer tag exactly."""

    def run(df: DataFrame, column: str) -> DataFrame:
        columns = {c: F.col(c) for c in df.columns}
        columns["query"] = query_with_references("query", list(references))
        answer = f"answer_{column}"
        out = ask_column(
            df, templates.fill(template, columns), answer, ask, lambda o: L.tag(o, "answer"), **params
        )
        return passed(out, answer, expected, column)

    return run


def search_input(tasks: DataFrame, occupations: DataFrame | None, *, n: int | None = None, seed: int = 0) -> DataFrame:
    """Distinct tasks, optionally of listed occupations and sampled, with a row id."""
    from ..operators import rounds
    from ..operators.scale import positions

    out = tasks.select("category_occ", "category_task", "task_detailed").distinct()
    out = rounds.occupation_filter(out, occupations)
    if n is not None:
        out = rounds.sample_rows(out, n, seed=seed, keys=["category_occ", "category_task"])
    return positions(out, [], [F.col("category_occ"), F.col("category_task"), F.col("task_detailed")], ROW)


# ---- checklists --------------------------------------------------------------


def generate_checklists(
    df: DataFrame, answer_template: str, item_template: str, ask: Ask, *, query: str = "query", **params
) -> DataFrame:
    """A first answer to each query, then the required items read from it."""
    columns = {c: F.col(c) for c in df.columns} | {"query": F.col(query)}

    def user(template, cols):
        return F.array(C.turn("user", templates.fill(template, cols)))

    df = ask_column(df, user(answer_template, columns), "query_out", ask, **params)
    columns = {"query": F.col(query), "query_out": F.col("query_out")}
    df = ask_column(df, user(item_template, columns), "__items", ask, lambda o: L.tags(o, "itemRequired"), raw="__raw", **params)
    return (
        df.withColumn("checklist_thinking", L.filled_tag("__raw", "thinking", attributes=True))
        .withColumn("checklist_required_items", L.checklist_items("__items"))
        .withColumn("checklist_required_count", F.size("checklist_required_items"))
        .drop("__items", "__raw")
    )


def score_checklists(
    df: DataFrame, models: list[str], evaluated_template: str, scoring_template: str, item_template: str, ask: Ask, *, query: str = "query",
) -> DataFrame:
    """Checklist score of every model's answer, one row per row and model."""
    rows = df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    columns = {c: F.col(c) for c in rows.columns} | {"query": F.col(query)}
    prompt = F.array(
        C.turn("system", F.concat(F.lit("model: "), F.col("model"))),
        C.turn("user", templates.fill(evaluated_template, columns)),
    )
    rows = ask_column(rows, prompt, "answer", ask)
    columns |= {
        "answer": F.col("answer"),
        "checklist": L.numbered_items("checklist_required_items", item_template),
    }
    scored = ask_column(rows, templates.fill(scoring_template, columns), "item_answers", ask, L.yes_no_items)
    return scored.withColumn("checklist_score", L.checklist_score("item_answers"))
