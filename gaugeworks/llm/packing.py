"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

Documents are dealt by hash into shards of a bounded number of pieces; each shard
is packed on its own, largest piece first.  The open bins of a shard are ordered
by residual room.  A bin carries a bitmap of its duplicate clusters and one of its
sources; the search starts at the tightest bin with room and goes on to its
successors until one has no conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised

CAPACITY = 4096
SOURCE_SLOTS = 4
SHARD_PIECES = 8192


def best_fit(lengths, sources, clusters, capacity: int, slots: int) -> list[int]:
    """Bin of each piece; pieces are taken in the given order.

    A bin holds at most one piece of a cluster (null: no cluster) and ``slots``
    of a source.  Sources and clusters that occur once need no bit.
    """
    def numbered(values):
        n: dict = {}
        for v in values:
            if v is not None:
                n[v] = n.get(v, 0) + 1
        often = [v for v, times in n.items() if times > 1]
        return {v: i for i, v in enumerate(often)}

    cluster_bit = {v: 1 << i for v, i in numbered(clusters).items()}
    # a source has a bit per slot; the lowest free one is taken
    source_bits = {v: [1 << (i * slots + k) for k in range(slots)] for v, i in numbered(sources).items()}
    room: list[tuple[int, int]] = []  # (residual, bin), the residual-ordered bins
    held_clusters: list[int] = []
    held_sources: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        own = cluster_bit.get(cluster, 0)
        places = source_bits.get(source, ())
        last = places[-1] if places else 0
        at = bisect_left(room, (length, -1))
        while at < len(room):
            b = room[at][1]
            if not (held_clusters[b] & own or held_sources[b] & last):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(held_clusters)
            held_clusters.append(0)
            held_sources.append(0)
        held_clusters[b] |= own
        for bit in places:
            if not held_sources[b] & bit:
                held_sources[b] |= bit
                break
        if left > length:
            insort(room, (left - length, b))
        out.append(b)
    return out


def _pack_shard(rows: pd.DataFrame, capacity: int, slots: int) -> pd.DataFrame:
    """Bins and places of the pieces of one shard."""
    rows = rows.sort_values(["length", "doc_id", "cluster", "source", "copy"], ascending=[False, True, True, True, True],
                            kind="stable", ignore_index=True)
    length = rows["length"].to_numpy()
    whole = length // capacity
    tail = length - whole * capacity
    # full pieces fill a bin each; the tail of each document is packed
    order = np.argsort(-tail, kind="stable")
    order = order[tail[order] > 0]
    value = lambda c: [None if pd.isna(v) else v for v in rows[c].iloc[order]]
    bins = best_fit(tail[order].tolist(), value("source"), value("cluster"), capacity, slots)
    packed = max(bins, default=-1) + 1
    filled: dict[int, int] = {}
    place = []
    for b, i in zip(bins, order):
        place.append(filled.get(b, 0))
        filled[b] = place[-1] + int(tail[i])
    full_row = np.repeat(np.arange(len(rows)), whole)
    full_piece = np.arange(len(full_row)) - np.repeat(np.cumsum(whole) - whole, whole)
    row = np.concatenate([full_row, order, np.flatnonzero(length == 0)])
    empty = int((length == 0).sum())
    out = rows.iloc[row][["doc_id", "copy", "source", "cluster"]].reset_index(drop=True)
    out["piece"] = np.concatenate([full_piece, whole[order], np.zeros(empty, np.int64)])
    out["start"] = out["piece"] * capacity
    out["length"] = np.concatenate([np.full(len(full_row), capacity), tail[order], np.zeros(empty, np.int64)])
    local = pd.array(
        np.concatenate([packed + np.arange(len(full_row)), np.array(bins, np.int64), np.zeros(empty, np.int64)]), "Int64"
    )
    bin_id = local + (int(rows["shard"].iloc[0]) << 32)
    if empty:
        bin_id[-empty:] = pd.NA
    out["bin_id"] = bin_id
    out["place"] = np.concatenate([np.zeros(len(full_row), np.int64), np.array(place, np.int64), np.zeros(empty, np.int64)])
    return out


def pack(
    items: DataFrame, *, capacity: int = CAPACITY, slots: int = SOURCE_SLOTS, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Pieces of documents with their bin and place.

    ``items`` has doc_id, length (tokens), source and cluster.  Returns doc_id,
    copy, source, cluster, piece, start and length (tokens of the document), bin_id
    and place (token of the bin).  Documents longer than ``capacity`` are cut into
    full pieces, which fill a bin each, and a tail.  A bin has at most one tail of a
    cluster and ``slots`` of a source.  A null source or cluster conflicts with
    nothing; null lengths count as 0; a document of length 0 needs no room and has
    a null bin.  Repeated rows are told apart by ``copy`` and spread over the
    shards.  Ties go by doc_id, cluster, source and copy.
    """
    each = materialised(
        items.select("doc_id", F.coalesce(F.col("length"), F.lit(0)).cast("bigint").alias("length"),
                     F.col("source").cast("string").alias("source"), F.col("cluster").cast("bigint").alias("cluster"))
        .groupBy("doc_id", "length", "source", "cluster").agg(F.count(F.lit(1)).alias("n"))
    )
    total = each.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    rows = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster", "copy"), F.lit(shards))
    )
    kind = items.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("shard").applyInPandas(
        lambda part: _pack_shard(part, capacity, slots),
        f"doc_id {kind}, copy bigint, source string, cluster bigint, piece bigint, start bigint, length bigint, "
        "bin_id bigint, place bigint",
    )
