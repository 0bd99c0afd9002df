"""Leaderboard documents: entries per model in the order of the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..operators import judging as J
from ..operators.scale import dense_ids, skew_join


def document_entries(
    scored: DataFrame, *, order: list[str], answers: DataFrame | None = None
) -> DataFrame:
    """One row per (model, question_idx) over the complete question grid.

    Entry i of every model belongs to the same question.  A question without a
    judgment has an empty entry.  With ``games`` the entry holds the judge's
    outputs (``judge``) and the answer of side B in the second game
    (``judge_answer``).
    """
    texts = ["judge_scores"]
    if "games" in scored.columns:
        second = F.get(F.get("games", F.lit(1))["prompt"], F.lit(1))["content"]
        scored = scored.withColumn("judge", J.judge_outputs_text("games")).withColumn(
            "judge_answer", C.judge_prompt_answer_b(second)
        )
        texts += ["judge", "judge_answer"]
    once = J.score_summary(J.once_per_answer(scored, order)).select(
        "uid", "model", "avg", "forward_score", "backward_score", *texts
    )
    filled = J.fill_grid(once, scored.select("uid"), scored.select("model"))
    if answers is None:
        filled = filled.withColumn("answer", F.lit(""))
    else:
        filled = filled.join(answers.select("uid", "model", "answer"), ["uid", "model"], "left").withColumn(
            "answer", F.coalesce("answer", F.lit(""))
        )
    numbered = skew_join(filled, dense_ids(scored, "uid", "question_idx"), ["uid"])
    return numbered.select(
        "model", "question_idx", "uid", "answer", "avg", "forward_score", "backward_score",
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
    )


def unequal_lengths(entries: DataFrame) -> DataFrame:
    """Models whose number of entries differs from the others (empty when sound)."""
    sizes = entries.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    bounds = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    return sizes.filter(F.lit(bounds["lo"] != bounds["hi"]))


def prompts(scored: DataFrame, questions: DataFrame, convo_text: str) -> DataFrame:
    """Conversation text of each judged question, numbered like the entries."""
    ids = dense_ids(scored, "uid", "question_idx")
    return ids.join(questions.select("uid", convo_text), "uid")


def boards(
    judgments: DataFrame, stratum: str, *, baseline: str, n_bootstrap: int = 100, seed: int = 0
) -> DataFrame:
    """Leaderboard of every stratum and of all battles, in one pass."""
    judged = judgments.withColumn("stratum", F.col(stratum).cast("string"))
    cells = J.with_all_stratum(J.cells_from_judgments(judged, ["stratum"]), "stratum")
    replicates = J.bootstrap_means(cells, ["stratum"], n_bootstrap=n_bootstrap, seed=seed)
    summary = J.replicate_summary(replicates, ["stratum"])
    return J.leaderboard(summary, ["stratum"], baseline=baseline)
