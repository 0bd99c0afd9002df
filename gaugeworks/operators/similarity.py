"""Exact top-k by inner product, with blocks of vectors skipped by their bounds.

Spark partitions the corpus; each task keeps its own top-k per query, so only k rows
per query and task are shuffled.  The queries are broadcast, as many at once as
``BLOCK_BYTES`` holds, and all of them share one scan of the corpus.

A task gathers a segment of vectors and sorts it into cells around a few of its own
vectors.  A cell has a centre and a radius: by Cauchy-Schwarz no vector of it can
have an inner product with q above ``q . centre + |q| radius``.  A query starts with
the cell of its highest bound and afterwards skips every cell whose bound lies below its
k-th similarity so far, which it carries from segment to segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import positions, spread, top_per_key

BLOCK_BYTES = 256 * 1024 * 1024
_MERGE_SLICES = 64
_SCORES_AT_ONCE = 4_000_000
_STEP = 4096
STATE_BYTES = 256 * 1024 * 1024  # similarities and ids a task holds for a block
SEGMENT_BYTES = 128 * 1024 * 1024  # vectors a task sorts into cells at once
_CELLS, _CELL_ROWS = 256, 8  # cells of a segment at most, rows of a cell on average at least
_SLACK = 1e-9  # of a bound, for rounding
_DIGITS = 12  # copies of a vector must tie, whatever order they are summed in


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, dim)


class _Running:
    """Best ``k`` vectors per query of a stream, ties to the lower id.

    Only vectors at or above a query's k-th similarity so far are collected; a
    full buffer is cut back to the best k.
    """

    def __init__(self, n: int, k: int, step: int, least: np.ndarray | None = None):
        self.k, self.step = k, step
        self.sims = np.full((n, 2 * k + step), -np.inf)
        self.ids = np.full((n, 2 * k + step), np.iinfo(np.int64).max)
        self.filled = np.zeros(n, np.int64)
        self.least = np.full(n, -np.inf) if least is None else least.copy()

    def add(self, sims: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Similarities of the queries ``rows`` to some vectors."""
        row, column = np.nonzero(sims >= self.least[rows, None])
        own = rows[row]
        count = np.bincount(own, minlength=len(self.least))
        full = np.flatnonzero(self.filled + count > self.sims.shape[1])
        if len(full):
            self.cut(full)
        first = np.cumsum(np.bincount(row, minlength=len(rows))) - np.bincount(row, minlength=len(rows))
        place = self.filled[own] + np.arange(len(row)) - first[row]
        self.sims[own, place] = sims[row, column]
        self.ids[own, place] = ids[column]
        self.filled += count

    def cut(self, rows: np.ndarray) -> None:
        """Keep the best k of these queries."""
        sims, ids, k = self.sims[rows], self.ids[rows], self.k
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
        tied = (sims >= least[:, None]).sum(axis=1) > k
        best = np.empty((len(rows), k), np.int64)
        best[~tied] = np.argpartition(-sims[~tied], k - 1, axis=1)[:, :k]
        best[tied] = np.lexsort((ids[tied], -sims[tied]), axis=1)[:, :k]
        self.sims[rows, k:], self.ids[rows, k:] = -np.inf, np.iinfo(np.int64).max
        self.sims[rows, :k] = np.take_along_axis(sims, best, 1)
        self.ids[rows, :k] = np.take_along_axis(ids, best, 1)
        self.filled[rows] = np.minimum(self.filled[rows], k)
        self.least[rows] = np.maximum(self.least[rows], least)  # -inf while there are fewer than k

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.cut(np.arange(len(self.sims)))
        width = int(self.filled.max(initial=0))
        return self.sims[:, :width], self.ids[:, :width]


def _step(n: int) -> int:
    """Vectors scored at once against ``n`` queries."""
    return max(1, min(_STEP, _SCORES_AT_ONCE // n))


class Cells:
    """Vectors of a segment sorted into cells, with the bounds of each cell."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n = len(vectors)
        count = max(1, min(_CELLS, n // _CELL_ROWS))
        pivots = vectors[np.linspace(0, n - 1, count).astype(np.int64)]
        offset = (pivots * pivots).sum(axis=1) / 2
        cell = np.concatenate([
            (vectors[at: at + _STEP] @ pivots.T - offset).argmax(axis=1) for at in range(0, n, _STEP)
        ])
        order = np.argsort(cell, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        starts = np.flatnonzero(np.diff(np.concatenate(([-1], cell[order]))))
        self.bounds = np.append(starts, n)
        sizes = np.diff(self.bounds)
        self.centres = np.add.reduceat(self.vectors, starts, axis=0) / sizes[:, None]
        gap = self.vectors - np.repeat(self.centres, sizes, axis=0)
        self.radius = np.sqrt(np.maximum.reduceat((gap * gap).sum(axis=1), starts))

    def search(self, queries: np.ndarray, running: _Running) -> int:
        """Add what the queries need of this segment; the number of similarities computed."""
        length = np.sqrt((queries * queries).sum(axis=1))
        most = queries @ self.centres.T + length[:, None] * self.radius + _SLACK
        best, scored = most.argmax(axis=1), 0
        for first in (True, False):  # the cell of the highest bound, then what may still count
            for cell in range(len(self.radius)):
                rows = np.flatnonzero(best == cell) if first else np.flatnonzero(
                    (best != cell) & (most[:, cell] >= running.least))
                if not len(rows):
                    continue
                step = min(_step(len(rows)), running.step)
                for at in range(self.bounds[cell], self.bounds[cell + 1], step):
                    stop = min(at + step, self.bounds[cell + 1])
                    scores = np.round(queries[rows] @ self.vectors[at:stop].T, _DIGITS)
                    running.add(scores, self.ids[at:stop], rows)
                    scored += scores.size
                if not first:
                    continue
                short = rows[running.filled[rows] >= running.k]
                if len(short):
                    running.cut(short)  # the k-th similarity so far
        return scored


def _scan(vectors: DataFrame, matrix: np.ndarray, first: int, k: int) -> DataFrame:
    """Candidates of all queries of a matrix; one row without query counts (scored, of all) per segment."""
    n, dim = matrix.shape
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    schema = "__q BIGINT, instance_idx BIGINT, sim DOUBLE, __slice INT"
    # queries whose candidates a task holds at once
    per_state = max(1, STATE_BYTES // (16 * (2 * k + _STEP)))

    def found(segment: list, least: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
        cells = Cells(np.concatenate([i for i, _ in segment]), np.concatenate([v for _, v in segment]))
        q, scored = shared.value, 0
        for low in range(0, n, per_state):
            own = slice(low, min(low + per_state, n))
            running = _Running(own.stop - low, k, _step(own.stop - low), least[own])
            scored += cells.search(q[own], running)
            sims, ids = running.result()
            least[own] = running.least
            row, column = np.nonzero(np.isfinite(sims))
            for at in range(0, len(row), 200_000):
                r, c = row[at: at + 200_000], column[at: at + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r + first + low), pa.array(ids[r, c]), pa.array(sims[r, c]), pa.array(np.full(len(r), piece, np.int32))],
                    names=["__q", "instance_idx", "sim", "__slice"],
                )
        total = float(n) * len(cells.ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([scored], pa.int64()), pa.array([total]), pa.array([piece], pa.int32())],
            names=["__q", "instance_idx", "sim", "__slice"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() % _MERGE_SLICES
        least, segment, size = np.full(n, -np.inf), [], 0
        for batch in batches:
            if len(batch):
                segment.append((batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)))
                size += segment[-1][1].nbytes
            if size >= SEGMENT_BYTES:
                yield from found(segment, least, piece)
                segment, size = [], 0
        if segment:
            yield from found(segment, least, piece)

    return vectors.mapInArrow(run, schema)


def _prepared(
    queries: DataFrame, vectors: DataFrame, k: int, query_keys: list[str], query_vector: str, vector_id: str, vector: str,
    block_bytes: int,
) -> tuple[DataFrame, DataFrame | None]:
    """Numbered queries and the candidates of all scans (None without queries)."""
    named = queries.select(*query_keys, F.col(query_vector).cast("array<double>").alias("__v"))
    n, dim = named.agg(F.count(F.lit(1)), F.max(F.size("__v"))).first()
    corpus = spread(vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("v")))
    # every task sends k rows per query: few long tasks send less than many short ones
    corpus = corpus.coalesce(2 * corpus.sparkSession.sparkContext.defaultParallelism)
    if not n:
        return named.limit(0).withColumn("__q", F.lit(0).cast("long")), None
    per_block = max(1, block_bytes // (8 * dim))
    if n <= per_block:  # at most block_bytes: numbered here
        rows = named.orderBy(*query_keys).toArrow()
        numbered = queries.sparkSession.createDataFrame(
            rows.select(query_keys).append_column("__q", pa.array(np.arange(n))),
        )
        return numbered, _scan(corpus, _matrix(rows.column("__v"), dim), 0, k)
    numbered = positions(named, [], [F.col(c) for c in query_keys], "__q")
    blocks = []
    for first in range(0, n, per_block):
        block = numbered.filter((F.col("__q") >= first) & (F.col("__q") < first + per_block))
        rows = block.select("__q", "__v").toArrow().sort_by("__q")
        blocks.append(_scan(corpus, _matrix(rows.column("__v"), dim), first, k))
    return numbered.drop("__v"), reduce(DataFrame.unionAll, blocks)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_keys: list[str],
    query_vector: str = "embedding",
    vector_id: str = "instance_idx",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rank table: query keys, ``instance_idx``, ``rank_idx`` from 0 and ``sim``.

    Ties go to the lower id.  Filter ``vectors`` first to restrict the search to
    some datasets; on a table partitioned by dataset that prunes the scan.
    """
    numbered, found = _prepared(queries, vectors, k, query_keys, query_vector, vector_id, vector, block_bytes)
    if found is None:
        fields = [queries.schema[c] for c in query_keys]
        ranks = [("instance_idx", T.LongType()), ("rank_idx", T.IntegerType()), ("sim", T.DoubleType())]
        return queries.sparkSession.createDataFrame([], T.StructType([*fields, *[T.StructField(n, t) for n, t in ranks]]))
    order = [F.desc("sim"), F.asc("instance_idx")]
    found = top_per_key(found.filter("__q is not null"), ["__q", "__slice"], order, k, "rank_idx").drop("__slice")
    out = top_per_key(found, ["__q"], order, k, "rank_idx")
    return out.join(numbered, "__q").select(*query_keys, "instance_idx", "rank_idx", "sim")


def scored_share(
    queries: DataFrame, vectors: DataFrame, k: int, *, query_keys: list[str], query_vector: str = "embedding",
    vector_id: str = "instance_idx", vector: str = "embedding", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(scored, pairs): similarities that ``top_k`` computes, and all pairs of queries and vectors."""
    _, found = _prepared(queries, vectors, k, query_keys, query_vector, vector_id, vector, block_bytes)
    if found is None:
        return queries.limit(0).agg(F.count(F.lit(1)).alias("scored"), F.count(F.lit(1)).alias("pairs"))
    return found.filter("__q is null").agg(
        F.sum("instance_idx").alias("scored"), F.sum("sim").cast("bigint").alias("pairs")
    )
