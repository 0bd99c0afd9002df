"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles.  The signature of an
item is its bottom-k sample under one hash function (the MinHash sketch that
estimates containment in a longer document without bias), and each partition has
the largest hash value of its signatures as a threshold: a document keeps, per
partition, only the shingles below it.  Documents that share enough of an item's
signature are verified by exact containment of the shingles themselves.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import materialised

WORDS = 5
THRESHOLD = 0.8
SIGNATURE = 16
NEEDED = 0.25  # of the signature; at containment 0.8 fewer than 4 of 16 occur once in 3 million


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per word shingle, unrolled inside generated code."""
    cut = df.select(*keep, _words(F.col("text")).alias("__w")).filter(F.size("__w") >= WORDS)
    rows = cut.select(*keep, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - WORDS)).alias("__i"))
    return rows.select(*keep, F.xxhash64(*[F.get("__w", F.col("__i") + k) for k in range(WORDS)]).alias("h"))


def _shingle_array(name: str) -> Column:
    """Distinct shingles of a text as strings; one with fewer words has none.

    The words are bound once, else they would be cut again for every shingle.
    """
    def shingles(w):
        places = F.sequence(F.lit(1), F.size(w) - WORDS + 1)
        each = F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.slice(w, i, WORDS))))
        return F.when(F.size(w) >= WORDS, each).otherwise(F.array().cast("array<string>"))

    return bind(_words(F.col(name)), shingles)


def signatures(items: DataFrame) -> DataFrame:
    """(item_id, h, needed, partition, limit): bottom-k shingle hashes of each item.

    ``partition`` is the power of two of the item's number of shingles, ``limit``
    the largest hash in the signatures of that partition.
    """
    each = _shingle_rows(items, ["item_id"]).groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    cut = each.select(
        "item_id", F.slice("hs", 1, SIGNATURE).alias("sig"), F.floor(F.log2(F.size("hs"))).cast("int").alias("partition")
    )
    limit = cut.groupBy("partition").agg(F.max(F.array_max("sig")).alias("limit"))
    return cut.join(limit, "partition").select(
        "item_id", F.explode("sig").alias("h"),
        F.ceil(F.size("sig") * F.lit(NEEDED)).cast("int").alias("needed"), "partition", "limit",
    )


def candidates(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a document holds enough of an item's signature."""
    top = signed.agg(F.max("limit")).first()[0]
    sketch = _shingle_rows(docs.filter("doc_id is not null"), ["doc_id"]).filter(F.col("h") <= F.lit(top).cast("bigint"))
    hits = sketch.join(signed, "h").filter("h <= limit").select("doc_id", "item_id", "needed", "h").distinct()
    return (
        hits.groupBy("doc_id", "item_id", "needed").agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= needed").select("doc_id", "item_id")
    )


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, containment): items of which a document holds ``threshold`` or more.

    Containment is the share of the item's distinct five-word shingles that occur
    in the document.  Words are runs of letters and digits, lower case.  Null or
    empty texts and items of fewer than five words match nothing; rows without
    doc_id or item_id can not be named and are left out; of rows that repeat an id
    the highest containment counts.
    """
    named = items.filter("item_id is not null and text is not null").select("item_id", "text")
    signed = materialised(signatures(named))
    found = materialised(candidates(docs.select("doc_id", "text"), signed))
    wanted = named.select("item_id", _shingle_array("text").alias("shingles")).filter(F.size("shingles") > 0)
    # an item id that repeats gives an entry per text; a document has as many as it has candidates
    lists = found.join(wanted, "item_id").groupBy("doc_id").agg(
        F.collect_set(F.struct("item_id", "shingles")).alias("items")
    )
    pairs = docs.select("doc_id", "text").join(lists, "doc_id").select(
        "doc_id", _shingle_array("text").alias("own"), "items"
    )
    checked = pairs.select(
        "doc_id",
        F.explode(
            F.transform(
                "items",
                lambda x: F.struct(
                    x["item_id"].alias("item_id"),
                    (F.size(F.array_intersect(x["shingles"], F.col("own"))) / F.size(x["shingles"])).alias("share"),
                ),
            )
        ).alias("x"),
    )
    return (
        checked.select("doc_id", "x.item_id", "x.share").filter(F.col("share") >= threshold)
        .groupBy("doc_id", "item_id").agg(F.max("share").alias("containment"))
    )


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id) of documents that hold at least one item."""
    return contained_items(docs, items, threshold=threshold).select("doc_id").distinct()


#: DuckDB twin of ``contained_items`` over documents and benchmark.
SQL = r"""
WITH dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
its AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) / max(n) AS containment
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) / max(n) >= 0.8
"""
