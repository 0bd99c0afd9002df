"""Rounds with carried state: a round reads its own predictions and what earlier ones left.

Per round three partitions are written: the pairs kept, the texts that an activity got
for the first time, as two 64-bit hashes, and the running counts per activity.  Writing
a round again replaces its partitions, so a failed round is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rounds
from ..operators.scale import skew_join, text_hashes
from ..session import materialised


def _write(df: DataFrame, base: str, name: str, round_idx: int) -> None:
    out = df.withColumn("round_idx", F.lit(round_idx))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round_idx").parquet(f"{base}/{name}")


def _earlier(spark: SparkSession, base: str, name: str, rounds_: Column) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}").filter(rounds_).drop("round_idx")


def advance(
    base: str, round_idx: int, pairs: DataFrame, preds: DataFrame, texts: DataFrame, *,
    keys: list[str], min_samples: int = 50, count_column: str = "n", dwa: str = "dwa", text: str = "text",
) -> DataFrame:
    """Counts per activity after a round, as ``rounds.deficient`` gives them over all rounds.

    ``preds`` are the predictions of this round only.  Rounds are numbered from 0
    without gaps.
    """
    spark = pairs.sparkSession
    kept = rounds.survivors(pairs, preds, rounds.chosen_steps(preds), keys=keys).select(*keys, dwa, "instance_idx")
    _write(kept, base, "kept", round_idx)
    kept = _earlier(spark, base, "kept", F.col("round_idx") == round_idx)
    hashed = texts.select("instance_idx", *text_hashes(text))
    fresh = skew_join(kept.select(dwa, "instance_idx").distinct(), hashed, ["instance_idx"]).select(dwa, "__h", "__g").distinct()
    if round_idx:
        seen = _earlier(spark, base, "texts", F.col("round_idx") < round_idx)
        fresh = fresh.join(seen, [dwa, "__h", "__g"], "left_anti")
    _write(fresh, base, "texts", round_idx)
    fresh = _earlier(spark, base, "texts", F.col("round_idx") == round_idx)
    zero = F.lit(0).cast("bigint")
    parts = [
        pairs.select(dwa).distinct().select(dwa, zero.alias("n"), zero.alias("n_inst_dedup")),
        kept.groupBy(dwa).agg(F.count(F.lit(1)).alias("n")).select(dwa, "n", zero.alias("n_inst_dedup")),
        fresh.groupBy(dwa).agg(F.count(F.lit(1)).alias("m")).select(dwa, zero.alias("n"), F.col("m").alias("n_inst_dedup")),
    ]
    if round_idx:
        parts.append(_earlier(spark, base, "counts", F.col("round_idx") == round_idx - 1).select(dwa, "n", "n_inst_dedup"))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    counts = materialised(total.groupBy(dwa).agg(F.sum("n").alias("n"), F.sum("n_inst_dedup").alias("n_inst_dedup")))
    _write(counts, base, "counts", round_idx)
    return counts.withColumn("cat_keep", F.col(count_column) < min_samples)
