"""SimHash near-duplicates, candidates pruned with a pigeonring filter.

A 64-bit fingerprint has four segments of 16 bits.  If two fingerprints differ in
at most three bits there is a segment from which, going round the ring, every
chain of 1, 2, 3 and 4 segments differs in at most 0, 1, 2 and 3 bits.  So each
fingerprint is filed under its four (segment, next segment) pairs and looks up
the same pairs with one more bit of the next segment set: a plain equi-join on 32
bits.  The longer chains are then tested before the full distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import skew_join
from ..session import materialised
from .common import components, slices

SEED = 42
DISTANCE = 3
_FULL = 8  # runs up to this length are compared pair by pair, longer ones by search


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of every word shingle; the whole sequence where it is shorter."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(ends)) - 1:])]


def fingerprint_values(texts: list[str], words: int) -> np.ndarray:
    """Majority of each bit over the shingles of each text; zero without a word."""
    each = [shingle_hashes(t, words) for t in texts]
    sizes = np.fromiter((len(h) for h in each), np.int64, len(each))
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
        starts = (np.cumsum(sizes) - sizes)[some]
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        on = (2 * ones > sizes[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint zero."""

    def run(batches):
        for batch, texts in slices(batches, 500_000):
            fp = fingerprint_values(texts, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _rotated(fp: np.ndarray, segment: int) -> np.ndarray:
    """The ring from ``segment`` on, in the low bits."""
    if not segment:
        return fp
    return (fp >> np.uint64(16 * segment)) | (fp << np.uint64(64 - 16 * segment))


def _filed(batches):
    """Keys a fingerprint is filed under and those it looks up."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        keys, owners, probes = [], [], []
        for segment in range(4):
            pair = _rotated(fp, segment) & np.uint64(0xFFFFFFFF)
            base = pair | np.uint64(segment << 32)
            keys.append(base)
            owners.append(fp)
            probes.append(np.zeros(len(fp), bool))
            for bit in range(16, 32):
                unset = (pair >> np.uint64(bit)) & np.uint64(1) == 0
                keys.append(base[unset] | np.uint64(1 << bit))
                owners.append(fp[unset])
                probes.append(np.ones(int(unset.sum()), bool))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys).view(np.int64)),
                pa.array(np.concatenate(owners).view(np.int64)),
                pa.array(np.concatenate(probes)),
            ],
            ["key", "fp", "probe"],
        )


def _near(a: np.ndarray, b, segment: int) -> np.ndarray:
    """Chains of two and three segments within their budgets, then the full distance."""
    gap = _rotated(a ^ b, segment)
    near = np.bitwise_count(gap & np.uint64(0xFFFFFFFF)) <= 1
    near &= np.bitwise_count(gap & np.uint64(0xFFFFFFFFFFFF)) <= 2
    return near & (np.bitwise_count(gap) <= DISTANCE)


def _tree(fp: np.ndarray, segment: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one run, one per member at most."""
    left, found = fp, []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = _near(left, x, segment)
            hits = left[near]
            if len(hits):
                found.append((np.full(len(hits), x), hits))
                stack.extend(hits)
                left = left[~near]
    return found


def _linked(batches):
    """Links within runs of equal key of a sorted stream."""
    key = np.zeros(0, np.int64)
    fp = np.zeros(0, np.uint64)
    probe = np.zeros(0, bool)

    def links(key, fp, probe):
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        filed = np.add.reduceat(~probe, starts, dtype=np.int64)
        useful = (sizes > 1) & (filed > 0)
        small = np.repeat(useful & (sizes <= _FULL), sizes)
        a, b = [], []
        k, f = key[small], fp[small]
        for step in range(1, _FULL):
            at = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else np.zeros(0, np.int64)
            if not len(at):
                break
            for segment in range(4):
                of = at[k[at] >> 32 == segment]
                of = of[_near(f[of], f[of + step], segment)]
                a.append(f[of])
                b.append(f[of + step])
        for run in np.flatnonzero(useful & (sizes > _FULL)):
            own = np.unique(fp[starts[run]: starts[run] + sizes[run]])
            for x, y in _tree(own, int(key[starts[run]] >> 32)):
                a.append(x)
                b.append(y)
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"]
            )

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        probe = np.concatenate((probe, batch.column("probe").to_numpy(zero_copy_only=False)))
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
        yield from links(key[:whole], fp[:whole], probe[:whole])
        key, fp, probe = key[whole:], fp[whole:], probe[whole:]
    yield from links(key, fp, probe)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints at three or fewer differing bits.

    Within a run of one key a connecting set of links is given, so that a large
    group of near copies never yields all its pairs; every other link joins
    fingerprints that these already connect.
    """
    filed = prints.select("fp").filter("fp is not null").distinct().mapInArrow(
        _filed, "key bigint, fp bigint, probe boolean"
    )
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable through links of at most
    three bits.  Null, empty and blank texts have fingerprint zero and link like
    any other; a row without doc_id takes part and never names a component unless
    no member has one (then null).  Repeated rows give repeated results.
    """
    prints = materialised(fingerprints(docs, words))
    classes = materialised(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    groups = components(fingerprint_links(classes)).withColumnRenamed("node", "fp")
    joined = classes.join(groups, "fp", "left")
    single = joined.filter("component is null").select("fp", F.col("first").alias("component_id"))
    several = joined.filter("component is not null")
    firsts = several.groupBy("component").agg(F.min("first").alias("component_id"))
    names = single.unionByName(several.join(firsts, "component").select("fp", "component_id"))
    out = skew_join(prints, names, ["fp"], "left", counts=classes.select("fp", "rows"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
