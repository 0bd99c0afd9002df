"""Training-data pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  The
first four return the columns of ``documents``; the last returns the packed
pieces.  ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import arrow_tokens, decontaminate, line_dedup, near_copies, packing, quality
from gaugeworks.session import materialised

#: The alignment, pigeonring and n-gram stages have no SQL form.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on the trusted ones accepts."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    scored = quality.classify(docs, trusted, perplexity="__perplexity", accepted="__accepted")
    return scored.filter("__accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of an earlier one.

    A document of which nothing is left goes; ``n_chars`` follows the text.
    """
    out = line_dedup.dedup_lines(docs, removed="__removed", spans="__spans")
    out = out.filter((F.col("__removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Near copies share 0.8 or more of their five-word shingles (Jaccard).
    Of rows that repeat a doc_id one stays.  Rows without doc_id can not be chosen
    by it and stay.
    """
    named = near_copies.one_row_per_id(docs)
    gone = near_copies.near_copies(named.select("doc_id", "text"), words=5).select(F.col("doc_id").alias("__gone"))
    kept = named.join(gone, named["doc_id"] == gone["__gone"], "left_anti")
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select(F.col("doc_id").alias("__found"))
    return docs.join(found, docs["doc_id"] == found["__found"], "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 4,096 tokens."""
    from public_tokenizers import path

    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.lower(F.trim("text"))).alias("cluster"))
    return packing.pack(arrow_tokens.token_lengths(rows, path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
