"""Document fingerprints by randomised edit embedding.

A shared random walk copies characters of a text: at step j it writes the current
character and moves on if the random bit of (j, character) says so.  Two texts
that walk in step write the same symbols, and fall back into step soon after an
edit, so edit distance becomes Hamming distance.  A text is walked in segments of
``SEGMENT`` characters (shorter texts are repeated to fill one); each written
symbol votes with a random sign on one bit of the fingerprint.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points

SEGMENT = 512
BITS = 256
STEPS = 3 * SEGMENT
CLASSES = 256
SEED = 20_240_501
SLICE = 1_000_000
_SIGNS = 4096  # segments before the sign patterns repeat
BAND_BITS = 12
BANDS = 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moves and votes per (step, class), and signs per (segment, bit)."""
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, (STEPS, CLASSES), dtype=np.uint8).astype(np.int64)
    votes = (rng.integers(0, 2, (STEPS, CLASSES), dtype=np.int8) * 2 - 1).astype(np.int8)
    moves[:, 0] = votes[:, 0] = 0  # class 0 is the end of a segment
    signs = (rng.integers(0, 2, (_SIGNS, BITS), dtype=np.int8) * 2 - 1).astype(np.int32)
    return moves, votes, signs


def embed(texts: list[str]) -> np.ndarray:
    """Fingerprint bits of each text, one row of ``BITS`` / 8 bytes each."""
    moves, votes, signs = _tables()
    filled = [t * (SEGMENT // len(t)) if 0 < len(t) <= SEGMENT // 2 else t for t in texts]
    points, bounds = code_points(filled)
    codes = (1 + (points ^ (points >> 8) ^ (points >> 16)) % (CLASSES - 1)).astype(np.uint8)
    parts = -(-np.diff(bounds) // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = bounds[owner] + number * SEGMENT
    length = np.minimum(SEGMENT, bounds[owner + 1] - start)
    width = SEGMENT + 1
    lanes = np.zeros((len(owner), width), np.uint8)
    inside = np.arange(width)[None, :] < length[:, None]
    lanes[inside] = codes  # segments lie one after the other
    flat = lanes.ravel()
    at = np.arange(len(owner), dtype=np.int64) * width
    total = np.zeros((BITS, len(owner)), np.int32)
    for step in range(STEPS):
        symbol = flat[at]
        total[step % BITS] += votes[step][symbol]
        at += moves[step][symbol]
    weighed = total.T * signs[number % _SIGNS]
    out = np.zeros((len(texts), BITS), np.int64)
    some = np.flatnonzero(parts)
    if len(some):
        out[some] = np.add.reduceat(weighed, (np.cumsum(parts) - parts)[some], axis=0)
    return np.packbits(out > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the walk two texts have in common, estimated from their bits."""
    apart = np.bitwise_count(a ^ b).sum(axis=1) / BITS
    return np.where(apart == 0, 1.0, np.clip(np.cos(np.pi * apart), 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many characters of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranged(docs: DataFrame, part_chars: int) -> DataFrame:
    """Rows in ranges of doc_id, each range followed by the first row of the next.

    The order is doc_id (nulls first), then the hash of the text; the last range
    is followed by the very first row.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    chars, = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-chars // part_chars))
    cuts = sorted(set(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # one literal per range: the place of the id among the sorted cuts
    part = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c) for c in cuts])
        part = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("__part", part)
    firsts = sorted(
        rows.groupBy("__part").agg(F.min(F.struct("doc_id", "__h")).alias("f")).collect(), key=lambda r: r["__part"]
    )
    if not firsts:
        return rows.withColumn("__after", F.lit(False))
    ends = [(firsts[i]["__part"], firsts[(i + 1) % len(firsts)]["f"]) for i in range(len(firsts))]
    ends = docs.sparkSession.createDataFrame(
        [(p, f["doc_id"], f["__h"]) for p, f in ends],
        f"__to int, __id {docs.schema['doc_id'].dataType.simpleString()}, __eh bigint",
    )
    # repeated first rows: one of each is enough
    follow = rows.join(
        F.broadcast(ends), rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__h"] == F.col("__eh"))
    ).select("doc_id", "text", "__h", F.col("__to").alias("__part"), F.lit(True).alias("__after"))
    follow = follow.dropDuplicates(["__part"])
    return rows.withColumn("__after", F.lit(False)).select(*follow.columns).union(follow)


def fingerprint(docs: DataFrame, *, part_chars: int = 8_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.  The next document is that of the next larger
    doc_id (numeric; nulls first, ties by the hash of the text), after the last
    the first; a single document is its own next.  Null texts count as empty; an
    empty text has the fingerprint of zeros.
    """
    ranged = _ranged(docs, part_chars)
    order = ["__part", "__after", "doc_id", "__h"]
    rows = ranged.repartition("__part").sortWithinPartitions(*order).select("doc_id", "text", "__part", "__after")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def answer(ids: pa.Array, texts: list[str]):
        """Results of all rows but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        bits = embed(texts + changed)
        own, after, new = bits[: len(changed)], bits[1: len(texts)], bits[len(texts):]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([b.tobytes().hex() for b in own]), pa.array([b.tobytes().hex() for b in new]),
                pa.array(likeness(own, new)), pa.array(likeness(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        ids, texts, part, size = [], [], None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "__part", "__after")]
            id_type = batch.column("doc_id").type
            for doc_id, text, own, after in zip(*columns):
                if own != part:
                    ids, texts, part, size = [], [], own, 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if len(texts) > 1 and (after or size > SLICE):
                    yield answer(pa.array(ids[:-1], id_type), texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def banded_links(prints: DataFrame, *, least: float = 0.8, bands: int = BANDS, band_bits: int = BAND_BITS) -> DataFrame:
    """(a, b, likeness) links between distinct fingerprints, by bit-sampled banding.

    ``prints`` has ``fingerprint`` (hex).  Each band samples ``band_bits`` bits.
    Within a bucket every fingerprint that is near another one is verified and
    linked, by a connecting set of links where there are many, so a large bucket
    never yields all its pairs.  Nulls are ignored.
    """
    rng = np.random.default_rng(SEED + 1)
    picks = [rng.choice(BITS, band_bits, replace=False) for _ in range(bands)]

    def run(batches):
        for batch in batches:
            texts = batch.column("fingerprint").to_pylist()
            if not texts:
                continue
            bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1), axis=1)
            for k, pick in enumerate(picks):
                value = bits[:, pick].astype(np.int64) @ (1 << np.arange(band_bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fingerprint"), pa.array(np.full(len(texts), k << 32) | value)], ["fingerprint", "bucket"]
                )

    distinct = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    def verified(run: list[str]):
        left = np.frombuffer(bytes.fromhex("".join(run)), np.uint8).reshape(len(run), -1)
        names = np.array(run, object)
        while len(left):
            stack, left, names = [(left[0], names[0])], left[1:], names[1:]
            while stack and len(left):
                bits, name = stack.pop()
                like = likeness(left, np.broadcast_to(bits, left.shape))
                near = like >= least
                for i in np.flatnonzero(near):
                    yield min(name, names[i]), max(name, names[i]), float(like[i])
                    stack.append((left[i], names[i]))
                left, names = left[~near], names[~near]

    def verify(batches):
        held, bucket = [], None
        for batch in batches:
            found = []
            for name, own in zip(batch.column("fingerprint").to_pylist(), batch.column("bucket").to_pylist()):
                if own != bucket:
                    found += verified(held) if len(held) > 1 else []
                    held, bucket = [], own
                held.append(name)
            yield from rows_of(found)
        yield from rows_of(list(verified(held)) if len(held) > 1 else [])

    def rows_of(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b", "likeness"])

    filed = distinct.mapInArrow(run, "fingerprint string, bucket bigint")
    runs = filed.repartition("bucket").sortWithinPartitions("bucket", "fingerprint")
    return runs.mapInArrow(verify, "a string, b string, likeness double").distinct()
