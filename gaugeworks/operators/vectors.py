"""Category texts and category vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .hierarchy import join_m1
from .scale import skew_join, stable_order


def category_text(task, occupation, mode: str = "headings") -> Column:
    task, occupation = (F.col(c) if isinstance(c, str) else c for c in (task, occupation))
    if mode == "headings":
        return F.concat(F.lit("Task: "), task, F.lit("\nOccupation: "), occupation)
    if mode == "concat":
        return F.concat(task, F.lit("\n"), occupation)
    raise ValueError(f"unknown text mode {mode!r}")


def truncate_tokens(text, limit: int) -> Column:
    """First ``limit`` white-space separated words of a text, spacing kept (not a model's tokens)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(text, rf"(?s)^(\s*(?:\S+\s*){{0,{limit}}})", 1)


def mean_pool(
    vectors: DataFrame, keys: list[str], *, vector: str = "embedding", n_trials: int | None = None
) -> DataFrame:
    """Mean vector per key.

    The mean is a JVM aggregate with partial sums, so a vector is never exploded
    into rows.  With ``n_trials`` every key must have exactly that many vectors.
    """
    out = vectors.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("__m"),
        F.count(F.lit(1)).alias("n_vectors"),
    )
    pooled = vector_to_array("__m")
    if n_trials is not None:
        pooled = F.when(F.col("n_vectors") == n_trials, pooled).otherwise(
            F.raise_error(F.lit(f"a category does not have {n_trials} vectors"))
        )
    return out.select(*keys, pooled.alias(vector), "n_vectors")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def normalised(vector) -> Column:
    """Vector divided by its length."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return bind(
        v,
        lambda x: bind(
            F.struct(x.alias("v"), _norm(x).alias("n")),
            lambda s: F.transform(s["v"], lambda e: e / s["n"]),
        ),
    )


def ensemble(*vectors) -> Column:
    """Mean over the methods, then unit length."""
    cols = [F.col(v) if isinstance(v, str) else v for v in vectors]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), cols)
    return normalised(F.transform(total, lambda x: x / F.lit(float(len(cols)))))


def sample_dwas(
    edges: DataFrame, n: int, *, seed: int, dwa: str = "dwa", saved: DataFrame | None = None
) -> DataFrame:
    """Rows of ``n`` sampled DWAs (all when there are fewer); a saved sample is reused."""
    chosen = saved
    if chosen is None:
        chosen = edges.select(dwa).distinct().orderBy(stable_order(seed, dwa), dwa).limit(n)
    return skew_join(edges, chosen.select(dwa).distinct(), [dwa], "left_semi")


def attach_iwa(edges: DataFrame, dwa_iwa: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the IWA title of each DWA; a DWA with two fails the job."""
    return join_m1(edges, dwa_iwa.select(*keys, "iwa_title"), keys)
