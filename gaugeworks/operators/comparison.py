"""Leaderboards next to each other: ranks, spreads, rank differences, tile order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import positions

SAMPLE_THRESHOLD = 0.6


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with a model name and a finite score."""
    score = F.col("score").cast("double")
    return rows.filter(
        F.coalesce(F.col("model") != "", F.lit(False))
        & score.isNotNull()
        & ~F.isnan(score)
        & (F.abs(score) != float("inf"))
    )


def ranks(rows: DataFrame) -> DataFrame:
    """Rank within a leaderboard: 1 is the highest score, ties in row order."""
    placed = positions(
        valid_rows(rows), ["lb_id"], [F.desc("score"), F.asc("pos")], "__p"
    )
    return placed.withColumn("rank", F.col("__p") + 1).drop("__p")


def spread(rows: DataFrame, value: str, models: DataFrame) -> DataFrame:
    """Range and mean of a value over the selected models per leaderboard."""
    chosen = rows.join(models.select("model").distinct(), "model", "left_semi")
    return chosen.groupBy("lb_id").agg(
        (F.max(value) - F.min(value)).alias("range"), F.avg(value).alias("mean")
    )


def rank_difference(ranked: DataFrame, other: str, models: DataFrame) -> DataFrame:
    """Total absolute rank difference of each leaderboard to another one.

    Models missing on either side are ignored; with nothing in common the
    difference is infinite and sorts last.
    """
    chosen = ranked.join(models.select("model").distinct(), "model", "left_semi")
    b = chosen.filter(F.col("lb_id") == other).select("model", F.col("rank").alias("__r"))
    sums = (
        chosen.join(b, "model")
        .groupBy("lb_id")
        .agg(F.sum(F.abs(F.col("rank") - F.col("__r"))).cast("double").alias("diff"))
    )
    return (
        ranked.select("lb_id").distinct().join(sums, "lb_id", "left")
        .withColumn("diff", F.coalesce("diff", F.lit(float("inf"))))
    )


def tile_order(tiles: DataFrame, value: str, *, descending: bool) -> DataFrame:
    """Position of each tile: valid values first in their direction, then manifest order.

    One row per leaderboard of the manifest.
    """
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v)
    direction = F.desc_nulls_last(F.when(ok, v)) if descending else F.asc_nulls_last(F.when(ok, v))
    return positions(tiles, [], [F.when(ok, 0).otherwise(1).asc(), direction, F.asc("idx")], "place")


def natural_key(text: Column) -> Column:
    """Lower-cased text with its numbers padded, for numeric-aware order."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, F.greatest(F.length(p), F.lit(20)), "0")).otherwise(p),
    )
    return F.array_join(padded, "")


def sort_rows(rows: DataFrame, by: str, *, ascending: bool = False) -> DataFrame:
    """Rows ordered by score as a number (missing last) or by numeric-aware text."""
    if by.lower() == "score":
        number = F.col(by).try_cast("double")
        number = F.when(~F.isnan(number), number)
        return rows.orderBy(number.asc_nulls_last() if ascending else number.desc_nulls_last())
    key = natural_key(F.coalesce(F.col(by).cast("string"), F.lit("")))
    return rows.orderBy(key.asc() if ascending else key.desc())


def column_order(rows: DataFrame) -> DataFrame:
    """Model and score first, then the other columns."""
    first = [c for c in ("model", "score") if c in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def nan_to_null(rows: DataFrame) -> DataFrame:
    floats = {f.name for f in rows.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return rows.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns]
    )


def comparison_summary(hypotheses: DataFrame, threshold: float = SAMPLE_THRESHOLD) -> DataFrame:
    """Samples above the threshold per hypothesis, largest effect first."""
    kept = F.map_keys(F.map_filter("sample2score", lambda k, v: v > threshold))
    return hypotheses.select("hypothesis", "mu", F.sort_array(kept).alias("samples")).orderBy(
        F.desc("mu")
    )


def group_members(groups: DataFrame, manifest: DataFrame) -> DataFrame:
    """Leaderboards of each group, in manifest order."""
    listed = groups.select("group_id", F.explode("members").alias("lb_id"))
    return positions(listed.join(manifest, "lb_id"), ["group_id"], [F.asc("idx")], "pos")
