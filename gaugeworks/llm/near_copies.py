"""Near copies by the Jaccard similarity of word shingles.

The pigeonring filter (``simhash``) sees fingerprints that differ in three bits,
which most pairs at similarity 0.8 to 0.95 do not.  Here its links are candidates
only; bands of compressed registers (``hyperminhash``) complete them: sets at
similarity 0.8 agree in none of the 32 bands once in twenty million.  Every candidate
is verified on the whole shingle sets.  No shingle is a key of a join: what is
shuffled are registers, bands and the texts of candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import first_per_key, skew_join
from ..session import materialised
from . import hyperminhash, simhash

LEAST = (80, 100)


def _fingerprint_pairs(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(a, b): classes and the first of their fingerprint, and the first ones of linked fingerprints."""
    # a class is seen through its first document
    prints = simhash.fingerprints(docs, words).withColumnRenamed("doc_id", "first")
    held = materialised(classes.select("class", "first").join(prints, "first").select("class", "fp"))
    groups = materialised(held.groupBy("fp").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("rows")))
    several = groups.filter("rows > 1")
    same = skew_join(held, several.select("fp", "least"), ["fp"], counts=several.select("fp", "rows"))
    least_a = groups.select(F.col("fp").alias("a"), F.col("least").alias("x"))
    least_b = groups.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    linked = simhash.fingerprint_links(groups).join(least_a, "a").join(least_b, "b").select("x", "y")
    pairs = same.select("class", "least").toDF("x", "y").union(linked).filter("x <> y")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame, *, words: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id) of the documents that a smaller doc_id makes superfluous.

    Such a document is joined to a smaller doc_id by a chain of documents whose
    neighbours have shingle sets at Jaccard similarity ``least`` or more, and no two
    of the other documents have it.  Texts of fewer than ``words`` words are one
    shingle; null, empty and blank texts are alike.  ``docs`` has one row per doc_id
    and none without.
    """
    prints = materialised(hyperminhash.signed(docs, words))
    classes = hyperminhash.classes_of(prints)
    candidates = _fingerprint_pairs(docs, classes, words)
    groups = hyperminhash.class_components(classes, docs, words, least, candidates)
    named = materialised(
        classes.select("class", "kind", "first", "rows").join(groups, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    stays = named.groupBy("component").agg(F.min("first").alias("stays"))
    kinds = named.select("kind", "component", "rows").join(stays, "component")
    full = skew_join(
        prints.filter("n > 0").select("doc_id", "kind"), kinds.select("kind", "stays"), ["kind"],
        counts=kinds.select("kind", "rows"),
    )
    blank = prints.filter("n = 0").select("doc_id")
    first_blank = blank.agg(F.min("doc_id").alias("stays"))  # one row
    return full.filter("doc_id <> stays").select("doc_id").union(
        blank.join(F.broadcast(first_blank), F.col("doc_id") > F.col("stays"), "left_semi")
    )


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, of those that repeat it the first by the hash of its text."""
    named = docs.filter("doc_id is not null")
    repeated = materialised(
        named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("__again"))
    )
    if repeated.isEmpty():
        return named
    same = named["doc_id"] == repeated["__again"]
    order = [F.xxhash64("text"), *[F.col(c) for c in docs.columns if c != "text"]]
    first = first_per_key(named.join(repeated, same, "left_semi"), ["doc_id"], order).select(*docs.columns)
    return materialised(named.join(repeated, same, "left_anti").union(first))
