"""From sampled pairs to answers, and from answers to judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..operators import judging as J
from ..operators import predictions as P
from . import interviews
from .asking import Ask, ask_column


def predict(
    pairs: DataFrame, models: list[str], ask: Ask, *, n: int = 50, seed: int = 0, drop_deficient: bool = True,
    dedupe: bool = False, idx: str = "idx",
) -> DataFrame:
    """Stratified sample, every model's answer, joined and checked export rows."""
    pick = P.stratified_sample_dedupe if dedupe else P.stratified_sample
    sample = pick(pairs, keys=[idx], n=n, seed=seed, drop_deficient=drop_deficient)
    answered = interviews.responses_per_model(sample, models, ask)
    sample, answered = (d.withColumnRenamed(idx, "idx") for d in (sample, answered))
    predictions = answered.select(
        "idx", "model", "response",
        C.fingerprint("convo_subset").alias("convo_hash"),
        F.when(F.col("response").isNull(), F.lit("no response")).alias("error"),
    )
    return P.export_join(sample, predictions)


def judge(
    questions: DataFrame, answers: DataFrame, baseline: str, ask: Ask, *, template: str, system: dict[str, str],
    judge_name: str, multi_turn: bool = True,
) -> DataFrame:
    """Both games of every model against the baseline, judged and collated."""
    inputs = J.judge_inputs(questions, answers, baseline)
    prompts = J.judge_prompts(inputs, template=template, system=system, multi_turn=multi_turn)
    outputs = ask_column(prompts, F.col("prompt"), "output", ask, judge=judge_name)
    return J.games_from_outputs(outputs, judge=judge_name)
