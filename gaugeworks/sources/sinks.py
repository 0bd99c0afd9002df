"""Writers: partitioned tables in place of one file per model, round or stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exchange, predictions
from ..operators.scale import first_per_key
from ..session import materialised


def write_predictions(df: DataFrame, base: str, *, run: str = "0") -> None:
    """Predictions by model, with the token log next to them.

    A resumed job adds another ``run``; writing the same run again replaces it, so a
    job that failed half way can simply be repeated.
    """
    df = materialised(df)
    lines = df.select("idx", "convo_hash", "request_hash", "response", "error", "model").withColumn("run", F.lit(run))
    _replace(lines, ["model", "run"]).json(f"{base}/predictions")
    _replace(exchange.token_log(df).withColumn("run", F.lit(run)), ["run"]).json(f"{base}/tokens")


def write_export(merged: DataFrame, base: str, *, mode: str = "overwrite") -> None:
    """Questions once over all models, answers by model, category table."""
    merged = materialised(merged)
    questions = first_per_key(predictions.questions(merged), ["uid"], [F.col("subcategory")])
    questions.write.mode(mode).json(f"{base}/questions")
    predictions.answers(merged).write.mode(mode).partitionBy("model").json(f"{base}/answers")
    predictions.category_first(merged).write.mode(mode).json(f"{base}/categories")


def write_judgments(df: DataFrame, base: str, *, run: str = "0") -> None:
    """Judgments by judge and model; the same ``run`` written again replaces its rows."""
    _replace(df.withColumn("run", F.lit(run)), ["judge", "model", "run"]).json(base)


def write_round(df: DataFrame, base: str, *, round_idx: int, step: str) -> None:
    """One step of one round as its own partition; writing it again replaces it."""
    named = df.withColumn("round_idx", F.lit(round_idx)).withColumn("step", F.lit(step))
    _replace(named, ["round_idx", "step"]).parquet(base)


def write_pairs(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_leaderboards(
    rows: DataFrame, base: str, *, group: str, entries: DataFrame | None = None, prompts: DataFrame | None = None
) -> None:
    """Leaderboard rows, manifest and group, documents by model.

    ``rows`` has the stratum; a leaderboard is named after group and stratum.  The
    tables are partitioned by group: other groups stay, the same one is replaced.
    """
    named = materialised(rows.withColumn("lb_id", F.concat_ws("/", F.lit(group), "stratum"))).withColumn(
        "group_id", F.lit(group)
    )
    _replace(named, ["group_id", "stratum"]).parquet(f"{base}/rows")
    manifest = named.select("lb_id", "stratum", "group_id").distinct()
    _replace(manifest, ["group_id"]).parquet(f"{base}/manifest")
    _replace(manifest.select("lb_id", "group_id"), ["group_id"]).parquet(f"{base}/groups")
    if entries is not None:
        entries.write.mode("overwrite").partitionBy("model").json(f"{base}/responses/{group}")
    if prompts is not None:
        prompts.write.mode("overwrite").json(f"{base}/prompts/{group}")


def _replace(df: DataFrame, by: list[str]):
    """Writer that replaces the partitions the rows have and leaves all others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def write_search(verified: DataFrame, not_found: DataFrame, intermediate: DataFrame, base: str) -> None:
    for name, df in (("verified", verified), ("not_found", not_found), ("intermediate", intermediate)):
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def write_task_tables(edges: DataFrame, task_space: DataFrame, base: str) -> None:
    edges.write.mode("overwrite").parquet(f"{base}/task_dwa")
    task_space.write.mode("overwrite").parquet(f"{base}/task_space")


def write_descriptions(tables: dict[str, DataFrame], base: str) -> None:
    """Description maps and classified activities, one table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
