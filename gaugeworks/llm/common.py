"""Helpers shared by the operators: slices of text, written tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised

SLICE_CHARS = 2_000_000
BROADCAST_IDS = 500_000  # 16 bytes each in a hash table, 8 MB


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS):
    """Cut Arrow batches into (batch, texts) of about ``limit`` characters.

    Null texts count as empty.  A slice has at least one row, so a single longer
    text still comes as a whole.
    """
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the bounds of each text."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive bounds, zero where they coincide."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def components(links: DataFrame) -> DataFrame:
    """Connected components of (a, b) links: (node, component), the smallest node.

    Alternates large-star and small-star steps on written edge tables until the
    edges are stars around their smallest nodes.  Every step sends the minimum of a
    node's neighbours along its edges, so the edges never grow in number and no group
    is collected.  Nodes without links do not occur.
    """
    edges = materialised(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours and the node itself move to the smallest
        small = large.join(low, "a")
        edges = materialised(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
    return edges.toDF("node", "component").union(edges.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour and no larger one, or none smaller."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def semi_join(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among the distinct values of ``ids`` (its only column).

    The ids are counted first: up to ``BROADCAST_IDS`` they are broadcast, so the
    texts of ``rows`` are not shuffled; more are joined by shuffle.  The result is
    the same.
    """
    name = f"__{key}"
    distinct = materialised(ids.toDF(name).filter(F.col(name).isNotNull()).distinct())
    if distinct.count() <= BROADCAST_IDS:
        distinct = F.broadcast(distinct)
    return rows.join(distinct, rows[key] == distinct[name], "left_semi")
