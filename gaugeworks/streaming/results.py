"""Append-only variants: new results only, running token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESPONSE


def responses(spark: SparkSession, folder: str, *, max_files: int = 1_000) -> DataFrame:
    """Stream of response files as they arrive."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", max_files).json(folder)


def first_results(
    stream: DataFrame, answered: DataFrame | None = None, *, arrived: str | None = None, late: str = "7 days"
) -> DataFrame:
    """Each (request, attempt) once; requests answered before the start are left out.

    With the time column ``arrived`` a pair is forgotten ``late`` after it came, so
    the state stays as large as that window.  Without one all pairs are kept.
    """
    if answered is not None:
        known = answered.select("request_hash").distinct()
        stream = stream.join(known, "request_hash", "left_anti")
    if arrived is None:
        return stream.dropDuplicates(["request_hash", "attempt"])
    return stream.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["request_hash", "attempt"])


def running_usage(stream: DataFrame) -> DataFrame:
    """Running token totals per model (complete or update mode)."""
    return stream.groupBy("model").agg(
        F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n_requests")
    )


def collect_results(stream: DataFrame, table: str, checkpoint: str):
    """Append new results to a table; restarts go on where the last run ended."""
    return (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
