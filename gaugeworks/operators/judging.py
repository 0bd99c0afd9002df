"""Pairwise judging: judge inputs, games, battles, leaderboards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import templates
from .scale import first_per_key, skew_join

ALL = "ALL"


def answer_text(messages="messages") -> Column:
    return C.last_content(messages)


def judge_inputs(questions: DataFrame, answers: DataFrame, baseline: str) -> DataFrame:
    """Two games per question and model: A is the baseline first, then the target.

    A model without an answer to a question is skipped; a missing baseline answer
    or a history that is not the question's conversation fails the job.  All
    models are handled by one join.
    """
    q = questions.select("uid", "category", "convo")
    target = answers.filter(F.col("model") != baseline).select(
        "uid", "model", F.col("messages").alias("target")
    )
    base = answers.filter(F.col("model") == baseline).select("uid", F.col("messages").alias("base"))
    joined = q.join(target, "uid").join(base, "uid", "left")

    def history_ok(m):
        return C.previous_turns(m) == F.col("convo")

    sound = F.col("base").isNotNull() & history_ok("target") & history_ok("base")
    reason = F.when(F.col("base").isNull(), "baseline answer missing").otherwise(
        "answer history differs from the question"
    )
    checked = joined.filter(
        F.when(sound, F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    )
    rows = checked.select(
        "uid", "category", "model", F.lit(baseline).alias("baseline"), "convo",
        answer_text("base").alias("__b"), answer_text("target").alias("__t"),
    )
    games = F.array(
        F.struct(F.lit(0).alias("game"), F.col("__b").alias("a"), F.col("__t").alias("b")),
        F.struct(F.lit(1).alias("game"), F.col("__t").alias("a"), F.col("__b").alias("b")),
    )
    return rows.withColumn("__g", F.explode(games)).select(
        "uid", "category", "model", "baseline", "convo",
        F.col("__g.game").alias("game"),
        F.col("__g.a").alias("answer_a"),
        F.col("__g.b").alias("answer_b"),
    )


def judge_prompts(
    inputs: DataFrame, *, template: str, system: dict[str, str], multi_turn: bool = True
) -> DataFrame:
    """Judge conversations from a template; the system text depends on the category."""
    columns = {
        "QUESTION": C.last_content("convo"),
        "ANSWER_A": F.col("answer_a"),
        "ANSWER_B": F.col("answer_b"),
    }
    if multi_turn:
        columns["CONVERSATION_HISTORY"] = C.render_history(C.previous_turns("convo"))
    missing = set(columns) - templates.fields(template)
    if missing:
        raise ValueError(f"judge template lacks {sorted(missing)}")
    system_text = L.lookup("category", system)
    return inputs.withColumn(
        "prompt",
        F.array(
            C.turn("system", system_text), C.turn("user", templates.fill(template, columns))
        ),
    )


def games_from_outputs(outputs: DataFrame, *, judge: str) -> DataFrame:
    """Forward and reverse game in one row; a missing output is a null game."""
    game = F.when(
        F.col("output").isNotNull(),
        F.struct(
            L.verdict("output").alias("score"),
            F.struct(F.col("output").alias("answer")).alias("judgment"),
            F.col("prompt").alias("prompt"),
        ),
    )
    keys = ["uid", "category", "model", "baseline"]
    sided = outputs.select(*keys, "game", game.alias("__g"))
    return (
        sided.groupBy(*keys)
        .agg(
            F.first(F.when(F.col("game") == 0, F.col("__g")), ignorenulls=True).alias("fwd"),
            F.first(F.when(F.col("game") == 1, F.col("__g")), ignorenulls=True).alias("rev"),
        )
        .select(
            "uid", "category", F.lit(judge).alias("judge"), "model", "baseline",
            F.array("fwd", "rev").alias("games"),
        )
    )


def game_scores(judgments: DataFrame) -> DataFrame:
    """The two verdicts of a judgment with array-valued games."""
    def verdict_of(i):
        return F.get(F.col("games"), F.lit(i))["score"]

    return judgments.withColumn("game1", verdict_of(0)).withColumn("game2", verdict_of(1))


def complete_games(judgments: DataFrame) -> DataFrame:
    return judgments.filter(F.col("game1").isNotNull() & F.col("game2").isNotNull())


def forward_scores(weight: int = L.STRONG_WEIGHT) -> Column:
    """Scores of the second game, where the target is on side A."""
    return L.verdict_scores("game2", weight)


def reverse_scores(weight: int = L.STRONG_WEIGHT) -> Column:
    return F.transform(L.verdict_scores("game1", weight), lambda s: F.lit(1.0) - s)


def with_scores(judgments: DataFrame, weight: int = L.STRONG_WEIGHT) -> DataFrame:
    return complete_games(judgments).withColumn("forward", forward_scores(weight)).withColumn(
        "reverse", reverse_scores(weight)
    )


def battles(judgments: DataFrame, weight: int = L.STRONG_WEIGHT) -> DataFrame:
    """One row per weighted score: game 2 as it is, then one minus game 1."""
    return (
        with_scores(judgments, weight)
        .withColumn("scores", F.explode(F.concat("forward", "reverse")))
        .drop("forward", "reverse")
    )


def attach_subcategory(judgments: DataFrame, questions: DataFrame, categories: DataFrame) -> DataFrame:
    """uid -> question -> category index and name."""
    q = questions.select(
        F.col("uid").cast("long").alias("uid"), F.col("subcategory").cast("int").alias("subcategory_idx")
    )
    c = categories.select(F.col("subcategory_idx").cast("int").alias("subcategory_idx"), "subcategory_name")
    return skew_join(
        skew_join(judgments.withColumn("uid", F.col("uid").cast("long")), q, ["uid"], "left"),
        c, ["subcategory_idx"], "left",
    )


def short_model(model="model") -> Column:
    """Model name without its path."""
    return F.try_element_at(F.split(F.col(model), "/"), F.lit(-1))


def score_cells(battle_rows: DataFrame, strata: list[str] = ()) -> DataFrame:
    """Number of battles per stratum, model and score.

    A score takes three values, so this is all that means, resamples and fits
    without covariates need; it is combined on the map side.
    """
    return (
        battle_rows.withColumn("model", short_model())
        .groupBy(*strata, "model", "scores")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cells_from_judgments(
    judgments: DataFrame, strata: list[str] = (), weight: int = L.STRONG_WEIGHT
) -> DataFrame:
    """Score cells without exploding battles: games are counted by verdict first."""
    base = complete_games(judgments).withColumn("model", short_model())
    by_verdict = base.groupBy(*strata, "model", "game1", "game2").agg(F.count(F.lit(1)).alias("__n"))
    scores = by_verdict.withColumn(
        "scores", F.explode(F.concat(forward_scores(weight), reverse_scores(weight)))
    )
    return scores.groupBy(*strata, "model", "scores").agg(F.sum("__n").alias("n"))


def with_all_stratum(cells: DataFrame, stratum: str) -> DataFrame:
    """Add the stratum ALL next to each stratum value."""
    named = cells.withColumn(stratum, F.col(stratum).cast("string"))
    both = named.withColumn(
        stratum, F.explode(F.array(F.lit(ALL), F.col(stratum)))
    )
    return both.groupBy(stratum, "model", "scores").agg(F.sum("n").alias("n"))


def means(cells: DataFrame, strata: list[str] = ()) -> DataFrame:
    return cells.groupBy(*strata, "model").agg(
        (F.sum(F.col("scores") * F.col("n")) / F.sum("n")).alias("score"),
        F.sum("n").alias("n_battles"),
    )


def bootstrap_means(
    cells: DataFrame, strata: list[str] = (), *, n_bootstrap: int = 100, seed: int = 0
) -> DataFrame:
    """Means of exact multinomial resamples of each model's battles.

    Drawing n rows with replacement and counting them per score is one
    multinomial draw over the score cells, so a replicate costs three numbers
    however many battles there are.
    """
    keys = [*strata, "model"]
    packed = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("scores", "n"))).alias("__c")
    ).select(
        *keys,
        F.xxhash64(F.lit(seed), *keys).alias("__seed"),
        F.col("__c.scores").alias("__s"),
        F.col("__c.n").alias("__n"),
    )

    def draw(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                values, counts = np.asarray(row[-2], float), np.asarray(row[-1], np.int64)
                total = counts.sum()
                rng = np.random.default_rng(row[-3] & 0xFFFFFFFFFFFFFFFF)
                weights = rng.multinomial(total, counts / total, size=n_bootstrap)
                part = pd.DataFrame(dict(zip(keys, row)), index=range(n_bootstrap))
                part["replicate"] = np.arange(n_bootstrap)
                part["mean"] = weights @ values / total
                parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", replicate BIGINT, mean DOUBLE"
    return packed.mapInPandas(draw, schema)


def replicate_summary(
    replicates: DataFrame, strata: list[str] = (), *, value: str = "mean", centre: str = "mean"
) -> DataFrame:
    """Centre and 5 % / 95 % quantiles over the replicates (linear interpolation)."""
    middle = F.avg(value) if centre == "mean" else F.percentile(value, F.lit(0.5))
    return replicates.groupBy(*strata, "model").agg(
        middle.alias("score"),
        F.percentile(value, F.lit(0.05)).alias("lower"),
        F.percentile(value, F.lit(0.95)).alias("upper"),
    )


def _percent(x: Column) -> Column:
    """Rounded to one decimal, as text."""
    return F.format_string("%.1f", F.round(x * 100, 1))


def ci_text(score: Column, lower: Column, upper: Column) -> Column:
    return F.concat(
        F.lit("(-"), _percent(score - lower), F.lit(" / +"), _percent(upper - score), F.lit(")")
    )


def leaderboard(
    summary: DataFrame, strata: list[str] = (), *, baseline: str | None = None
) -> DataFrame:
    """Display table: score in percent, interval text, baseline at 50.0 when absent."""
    rows = summary.select(
        *strata, "model",
        F.round(F.col("score") * 100, 1).alias("score"),
        ci_text(F.col("score"), F.col("lower"), F.col("upper")).alias("ci"),
    )
    if baseline is None:
        return rows
    base = rows.select(*strata).distinct() if strata else rows.sparkSession.range(1).select()
    base = base.select(
        *strata, F.lit(baseline).alias("model"), F.lit(50.0).alias("score"),
        F.lit("(-0.0 / +0.0)").alias("ci"),
    ).join(rows.select(*strata, "model"), [*strata, "model"], "left_anti")
    return rows.unionByName(base)


def fill_grid(df: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Complete grid of two key tables with the values left joined.

    The second key table is a short list of names (models); it is folded into an
    array and exploded, so the grid is built without a join.
    """
    name = columns.columns[0]
    # one entry per model
    values = sorted(r[0] for r in columns.distinct().collect())
    grid = rows.distinct().withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df, [*rows.columns, name], "left")


# fixed value: text of the scores of a judgment
SCORE_TEXT = ("Avg. score: ", " / 3.0\tForward score: ", "\tReverse score: ")


def score_summary(scored: DataFrame) -> DataFrame:
    """Forward, reverse and average score per judgment."""
    def total(c):
        return F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)

    out = scored.withColumn("forward_score", total("forward")).withColumn(
        "backward_score", total("reverse")
    ).withColumn("avg", (F.col("forward_score") + F.col("backward_score")) / 2)
    return out.withColumn(
        "judge_scores",
        F.concat(*[
            part for text, name in zip(SCORE_TEXT, ("avg", "forward_score", "backward_score"))
            for part in (F.lit(text), F.col(name).cast("string"))
        ]),
    )


def judge_outputs_text(games="games") -> Column:
    """Judge outputs of the games under numbered heads."""
    blocks = F.transform(
        F.col(games),
        lambda g, i: F.concat(
            F.lit("(Judge output "), (i + 1).cast("string"), F.lit("):\n"), g["judgment"]["answer"]
        ),
    )
    return F.array_join(blocks, "\n" + "-" * 80 + "\n")


def once_per_answer(scored: DataFrame, order: list[str]) -> DataFrame:
    """One judgment per (uid, model), the first in the given order."""
    return first_per_key(scored, ["uid", "model"], [F.col(o) for o in order])

