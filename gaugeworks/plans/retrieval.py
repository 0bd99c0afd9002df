"""From categories to ranked conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity, vectors
from .asking import Ask, embed_column

CATEGORY = ["category_task", "category_occ", "dwa"]


def category_vectors(
    categories: DataFrame, ask: Ask, *, examples: DataFrame | None = None, n_trials: int | None = None,
    mode: str = "concat",
) -> DataFrame:
    """Vector per category: its text, averaged with the mean of its example vectors.

    ``examples`` has the category and ``embedding`` of each generated example.
    Texts go out whole: the client knows its model's tokens and limit.
    """
    text = vectors.category_text("category_task", "category_occ", mode)
    out = embed_column(categories.select(*CATEGORY).distinct(), text, "by_text", ask)
    if examples is None:
        return out.select(*CATEGORY, vectors.normalised("by_text").alias("embedding"))
    pooled = vectors.mean_pool(examples, CATEGORY, n_trials=n_trials)
    both = out.join(pooled.withColumnRenamed("embedding", "by_examples"), CATEGORY)
    return both.select(
        *CATEGORY, vectors.ensemble(F.col("by_text").cast("array<double>"), "by_examples").alias("embedding")
    )


def retrieve(
    category_table: DataFrame, corpus: DataFrame, *, top_k: int = 1_000, datasets: list[str] | None = None
) -> DataFrame:
    """Ranked pairs; a dataset restriction prunes a corpus partitioned by dataset."""
    if datasets is not None:
        corpus = corpus.filter(F.col("dset_name").isin(*datasets))
    return similarity.top_k(category_table, corpus, top_k, query_keys=CATEGORY)
