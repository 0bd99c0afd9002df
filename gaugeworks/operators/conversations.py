"""Conversation tables: assembly from turn rows, text columns, distinct counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from .scale import distinct_texts

_COUNTS = ("n", "n_instances", "n_texts")


def from_turns(
    turns: DataFrame,
    *,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation, all its turns in order, from one row per turn."""
    entry = F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")
    )
    return (
        turns.groupBy(key)
        .agg(F.sort_array(F.collect_list(entry)).alias("__t"))
        .select(key, F.transform("__t", lambda t: C.turn(t["role"], t["content"])).alias("convo"))
    )


def with_text_columns(df: DataFrame, convo: str = "convo") -> DataFrame:
    return df.withColumn("instance_text", C.render(convo)).withColumn(
        "instance_text_human_only", C.render_human_only(convo)
    )


def lint_convos(df: DataFrame, convo: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a clean conversation, and the rows that break the turn schema."""
    marked = df.withColumn("__c", C.lint(convo))
    good = marked.filter(F.col("__c").isNotNull()).withColumn(convo, F.col("__c")).drop("__c")
    return good, marked.filter(F.col("__c").isNull()).drop("__c")


def dedupe_counts(pairs: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Number of pairs, of distinct conversations and of distinct texts."""
    ids = pairs.select(key).distinct()
    found = distinct_texts(ids, texts, [], key, text, "__n")

    def counted(df, name):
        return df.select(
            *[F.lit(1 if n == name else None).cast("long").alias(n) for n in _COUNTS]
        )

    parts = zip((pairs, ids), _COUNTS)
    rows = reduce(DataFrame.unionAll, [counted(df, n) for df, n in parts])
    sums = rows.agg(*[F.count(n).alias(n) for n in _COUNTS[:2]])
    # one row on each side
    return sums.select(*_COUNTS[:2], F.lit(found.first()[0]).cast("long").alias(_COUNTS[2]))
