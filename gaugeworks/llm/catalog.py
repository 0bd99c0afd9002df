"""Registered queries of the corpus operators and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    arrow_tokens,
    collocations,
    conversation_repair,
    decontaminate,
    edit_fingerprint,
    hyperminhash,
    language_id,
    line_dedup,
    packing,
    quality,
    simhash,
    token_counts,
    toxicity,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_hash():
    """crc32 of the decimal document id, the split both labelled queries use."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, id_hash() % 5 != 0)
    out = language_id.identify(docs, model)
    return out.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "lang_pred", "score")


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3)


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


LLM_SQL["op5_decontamination"] = decontaminate.SQL


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").filter("quality = 1")
    out = quality.classify(table(spark, folder, "documents"), trusted)
    return out.select("doc_id", "perplexity", "accepted")


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), id_hash() % 4 != 2)
    out = toxicity.rate(docs, model)
    return out.select(
        "doc_id", (id_hash() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_edit_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprint.fingerprint(table(spark, folder, "documents"))


@query
def op6_arrow_tokens(spark: SparkSession, folder: str) -> DataFrame:
    place = arrow_tokens.token_folder(spark)
    manifest = arrow_tokens.write_tokens(
        table(spark, folder, "documents"), place, tokenizer("word_bpe_49k.json")
    )
    return arrow_tokens.read_tokens(manifest, place)


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), PATTERN)


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("cluster", F.xxhash64(F.lower(F.trim("text"))))
    sized = arrow_tokens.token_lengths(
        docs.select("doc_id", "text", "source", "cluster"), tokenizer("word_bpe_49k.json")
    )
    return packing.pack(sized)


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(table(spark, folder, "conversations"))


LLM_SQL["op11_conversation_repair"] = conversation_repair.SQL


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


LLM_SQL["op12_collocations"] = collocations.SQL


@query
def op13_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
