"""Stratified samples of pairs, prediction rows and the question / answer export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from .scale import first_per_key, positions, stable_order, top_per_key, with_group_stats

MISSING_RESPONSE = "Server error"
_GROUP_LIMIT = 1_000


def stratified_sample(
    df: DataFrame,
    *,
    category: str = "category_idx",
    keys: list[str] = ("instance_idx",),
    n: int = 50,
    seed: int = 0,
    drop_deficient: bool = True,
) -> DataFrame:
    """``n`` rows per category in seeded hash order.

    Categories with fewer rows are dropped, or kept whole.  Only the first n
    rows per category and map task are shuffled; the size check counts with
    partial sums.
    """
    order = [stable_order(seed, category, *keys), *[F.col(k) for k in keys]]
    present = df.filter(F.col(category).isNotNull())
    if n <= _GROUP_LIMIT:
        picked = top_per_key(present, [category], order, n, "__rank")
    else:
        picked = positions(present, [category], order, "__rank").filter(F.col("__rank") < n)
    if drop_deficient:
        # what was picked is complete unless the category ran short
        picked = with_group_stats(picked, [category], [F.count(F.lit(1)).alias("__n")])
        picked = picked.filter(F.col("__n") == n).drop("__n")
    return picked.drop("__rank")


def stratified_sample_dedupe(
    df: DataFrame,
    *,
    convo: str = "convo_subset",
    category: str = "category_idx",
    keys: list[str] = ("instance_idx",),
    **kwargs,
) -> DataFrame:
    """The same after keeping the first row of each rendered conversation per category."""
    hashed = df.withColumn("__text", F.sha2(C.render(convo), 256))
    once = first_per_key(hashed, [category, "__text"], [F.col(k) for k in keys]).drop("__text")
    return stratified_sample(once, category=category, keys=keys, **kwargs)


def prediction_rows(df: DataFrame, *, idx: str = "idx", convo: str = "convo_subset") -> DataFrame:
    """Prediction rows: hashes and either a response or an error."""
    return df.select(
        F.col(idx).alias("idx"),
        C.fingerprint(convo).alias("convo_hash"),
        "request_hash",
        F.col("output").alias("response"),
        F.when(F.col("output").isNull(), F.coalesce("error", F.lit("no response"))).alias("error"),
    )


def export_join(
    turns: DataFrame,
    predictions: DataFrame,
    *,
    convo: str = "convo_subset",
    strict: bool = True,
    missing: str = MISSING_RESPONSE,
) -> DataFrame:
    """Join predictions to their turns and compare the conversation hashes.

    A missing response is filled in.  A hash mismatch fails the job, or drops
    the row when not strict.
    """
    left = turns.withColumn("convo_subset_hash", C.fingerprint(convo))
    merged = left.join(predictions, "idx", "right").withColumn(
        "response", F.coalesce("response", F.lit(missing))
    )
    same = F.col("convo_subset_hash").eqNullSafe(F.col("convo_hash"))
    if not strict:
        return merged.filter(same)
    return merged.withColumn(
        "convo_hash",
        F.when(same, F.col("convo_hash")).otherwise(
            F.raise_error(F.lit("conversation hash of a prediction does not match"))
        ),
    )


def error_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors")
    )


def questions(merged: DataFrame, *, convo: str = "convo_subset", category: str = "ei") -> DataFrame:
    return merged.select(
        F.col("idx").cast("string").alias("uid"),
        F.lit(category).alias("category"),
        F.col("category_idx").cast("string").alias("subcategory"),
        F.col(convo).alias("convo"),
    )


def answers(merged: DataFrame, *, convo: str = "convo_subset") -> DataFrame:
    """Answer records: the conversation with the response appended."""
    uid = F.col("idx").cast("string")
    return merged.select(
        uid.alias("uid"),
        F.concat_ws("-", "model", uid).alias("ans_id"),
        "model",
        C.append_answer(convo, "response").alias("messages"),
        F.lit(0.0).alias("tstamp"),
        F.create_map().cast("map<string,double>").alias("metadata"),
    )


def category_first(
    merged: DataFrame, *, order: list[str] = ("idx",), columns: list[str] = ("dwa", "dwa_detailed")
) -> DataFrame:
    """First row per category with the export names."""
    present = [c for c in columns if c in merged.columns]
    first = first_per_key(merged, ["category_idx"], [F.col(o) for o in order])
    names = {"category_idx": "subcategory_idx", "dwa": "subcategory_name"}
    return first.select(*[F.col(c).alias(names.get(c, c)) for c in ("category_idx", *present)])


def per_model_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of per-model tables with the model as a column."""
    out = None
    for model, df in parts.items():
        df = df.withColumn("model", F.lit(model))
        out = df if out is None else out.unionByName(df)
    return out

