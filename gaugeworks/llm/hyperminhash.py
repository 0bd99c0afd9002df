"""Near duplicates by HyperMinHash: compressed registers, banding, exact check.

A shingle hash is dealt to one of ``BUCKETS`` buckets by its first bits; of the
smallest remainder in a bucket a 16-bit register keeps the number of leading zeros
and the ten bits behind the first one.  A bucket without a shingle takes the
minimum of all shingles under a hash function of its own, so that each register
of two sets agrees with their Jaccard similarity as its probability, plus that of
an accidental agreement, which the estimate takes off again.

Four neighbouring registers are one 64-bit band.  Sets at similarity 0.85 agree in
a band with probability 0.52 and in none of the 32 bands once in ten billion.

1. Texts of the same shingle set are one class; the rest works on classes.
2. Every class meets the hub of each of its bands: the class whose bands are shared
   most.  So a group of near copies gives a link per member.
3. Where the members of a band are not connected by now, those of different
   components meet too, but only if they share one of the rarest shingles in which
   they differ from the hub: no pair at the similarity is without one (see
   ``differences``), and nearly all other pairs of a group are.

Candidates whose corrected estimate is too low are dropped, the others are
verified on the whole shingle sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import first_per_key, skew_join
from ..session import materialised
from .common import components, semi_join, slices

WORDS = 5
LEAST = (85, 100)  # similarity as a fraction
BUCKETS = 128
MANTISSA = 10
BAND = 4  # registers of a band
MARGIN = 0.3  # an estimate may lie so much below the similarity: eight deviations for full buckets
_REST = 57  # bits of a hash behind those that name the bucket
_MASK = np.uint64((1 << _REST) - 1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(_REST)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1000, 1000 + BUCKETS, dtype=np.uint64)) | np.uint64(1)  # odd factors
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: a polynomial over random byte values, then mixed.

    One pass over all bytes: with an odd base a range is a difference of prefix sums
    times a power of the inverse.  Very long words are hashed one by one, since
    polynomials of that degree can be made to collide on purpose.
    """
    powers, inverse = _powers(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * powers, out=prefix[1:])
    out = mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > 255):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]: ends[i]].tobytes())
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest slice so far."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate((one, np.full(n, b, np.uint64)))) for one, b in
                      ((np.ones(1, np.uint64), _BASE), (np.ones(1, np.uint64), _INVERSE))]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    Words are runs of other characters than ASCII blanks, A-Z in lower case.  A
    text of fewer words is one shingle, one without words has none.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    raw = _LOWER[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    word = raw != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    each = _word_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    value = np.full(max(0, len(each) - words + 1), words, np.uint64)
    for k in range(words):
        value = mixed(value + each[k: k + len(value)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(value[a: b - words + 1]))
        else:  # the whole sequence; no words, no shingle
            whole = np.full(min(1, b - a), b - a, np.uint64)
            for k in range(a, b):
                whole = mixed(whole + each[k])
            out.append(whole)
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """57-bit minimum of each bucket for a sorted set that is not empty."""
    at = np.searchsorted(hashes, _BOUNDS)
    first = hashes[np.minimum(at, len(hashes) - 1)]
    out = first & _MASK
    bare = np.flatnonzero((at == len(hashes)) | (first >> np.uint64(_REST) != np.arange(BUCKETS, dtype=np.uint64)))
    if len(bare):
        out[bare] = (hashes[:, None] * _SEEDS[bare]).min(axis=0) >> np.uint64(7)
    return out


def compressed(values: np.ndarray) -> np.ndarray:
    """16-bit registers: leading zeros of a 57-bit value and the bits behind its first one."""
    filled = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        filled |= filled >> np.uint64(step)
    zeros = np.uint64(_REST) - np.bitwise_count(filled).astype(np.uint64)
    behind = ((values << zeros) >> np.uint64(_REST - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << np.uint64(MANTISSA)) | behind).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BUCKETS) registers; zero for empty sets."""
    values = np.zeros((len(sets), BUCKETS), np.uint64)
    for row, hashes in zip(values, sets):
        if len(hashes):
            row[:] = minima(hashes)
    return compressed(values)


@lru_cache(maxsize=4096)
def _chance(a: int, b: int) -> float:
    """Probability that the registers of unrelated sets of 2^(a/2) and 2^(b/2) shingles agree."""
    def cells(size: int) -> np.ndarray:
        per_bucket = max(1.0, 2.0 ** (size / 2) / BUCKETS)
        high = 2.0 ** -np.arange(_REST)[:, None]
        steps = 1 << MANTISSA
        edges = high * (0.5 + np.arange(steps + 1) / (2 * steps))
        return np.exp(-per_bucket * edges[:, :-1]) - np.exp(-per_bucket * edges[:, 1:])

    return float((cells(a) * cells(b)).sum())


def estimate(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the agreeing registers less those that agree by chance."""
    share = (a == b).mean(axis=1)
    kinds = [np.rint(2 * np.log2(np.maximum(s, 1))).astype(int) for s in (sizes_a, sizes_b)]
    chance = np.array([_chance(int(x), int(y)) for x, y in zip(*kinds)])
    return (share - chance) / (1 - chance)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, kind, regs): size, digest and registers of every row's shingle set."""

    def run(batches):
        for batch, texts in slices(batches, 500_000):
            sets = shingle_sets(texts, words)
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["doc_id", "n", "kind", "regs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, kind binary, regs binary")


def classes_of(prints: DataFrame) -> DataFrame:
    """(class, kind, first, rows, n, regs): one row per shingle set that is not empty, numbered."""
    grouped = prints.filter("n > 0 and doc_id is not null").groupBy("kind").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("regs").alias("regs")
    )
    return materialised(grouped.withColumn("class", F.monotonically_increasing_id()))


def _banded(batches):
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint64).reshape(-1, BUCKETS // BAND)
        keys = mixed(regs + _BOUNDS[: regs.shape[1]])  # another key in every band
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.ravel().view(np.int64)),
                pa.array(np.tile(np.arange(regs.shape[1], dtype=np.int16), len(regs))),
                batch.column("class").take(pa.array(np.repeat(np.arange(len(regs)), regs.shape[1]))),
                batch.column("n").take(pa.array(np.repeat(np.arange(len(regs)), regs.shape[1]))),
            ],
            ["key", "band", "class", "n"],
        )


def shared_bands(classes: DataFrame) -> DataFrame:
    """(key, band, class, n, rows): bands that several classes have."""
    bands = materialised(
        classes.select("class", "n", "regs").mapInArrow(_banded, "key bigint, band smallint, class bigint, n bigint")
    )
    runs = materialised(bands.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    return materialised(skew_join(bands, runs, ["key"], counts=runs))


def _alike(n: str, m: str, least: tuple[int, int]):
    """Sets of such sizes can have the similarity."""
    return F.least(n, m) * least[1] >= F.greatest(n, m) * least[0]


def _ordered(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def met_hubs(shared: DataFrame) -> DataFrame:
    """(key, class, n, hub, m, rows): every class and the hub of each of its bands.

    The hub of a band is the class whose bands are shared most, the one that a group
    of near copies comes from or the copy closest to it.
    """
    weight = shared.groupBy("class").agg(F.sum("rows").alias("weight"))
    weighed = shared.select("key", "class", "n").join(weight, "class")
    hubs = first_per_key(weighed, ["key"], [F.desc("weight"), F.asc("class")]).select(
        "key", F.col("class").alias("hub"), F.col("n").alias("m")
    )
    runs = shared.groupBy("key").agg(F.first("rows").alias("rows"))
    met = skew_join(shared.select("key", "class", "n", "rows"), hubs, ["key"], counts=runs)
    return materialised(met.filter("class <> hub"))


def open_groups(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(class, hub, component): classes that met a hub in a band whose other members are not all connected."""
    # a band of two has nothing left to test
    rows = met.filter("rows > 2").select("key", "class", "hub").join(groups, "class", "left")
    rows = materialised(rows.withColumn("component", F.coalesce("component", "class")))
    several = rows.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")
    ).filter("lo <> hi")
    several = materialised(several.select("key", "rows"))
    kept = skew_join(rows, several.select("key"), ["key"], "left_semi", counts=several)
    return materialised(kept.select("class", "hub", "component").distinct())


def whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(class, hashes): the sorted shingle sets of the wanted classes, cut again from their first document."""
    named = materialised(classes.select("class", "kind", "first").join(wanted.select("class").distinct(), "class"))
    texts = semi_join(docs.select("doc_id", "text"), named.select("first"), "doc_id")

    def cut(batches):
        for batch, texts in slices(batches, 500_000):
            sets = shingle_sets(texts, words)
            kinds = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["kind", "hashes"]
            )

    sets = texts.mapInArrow(cut, "kind binary, hashes array<bigint>").join(named.select("kind", "class"), "kind")
    return materialised(sets.select("class", "hashes").dropDuplicates(["class"]))


def differences(opened: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(hub, class, component, linked, short, long, inside, h): how each class differs from its hub, in few shingles.

    Let e be the shingles that only one of class and hub has, and c = (1 - t) / (1 + t):
    two sets have similarity t if they differ in c of their sizes or less, so what they
    differ from the hub in must overlap.  If one of them is not linked to the hub,
    more than (e + c (hub - own)) / 2 of the other's differences are shared; if the
    other is linked, so are e - c (1 + 1/t) own of its own.  As in every prefix filter
    the first e - overlap + 1 differences under a common order then have one in common.
    ``short`` and ``long`` are these lengths for the two cases.

    A set lacks at most (1 - t) own shingles of a similar one.  A class with more than
    that outside the hub shares one of those, so it needs (1 - t) own + 1 of them and none
    that the hub has (``inside``): such ones nearly all classes of a large group lack.
    """
    t = least[0] / least[1]
    c = (1 - t) / (1 + t)
    both = opened.join(sets.toDF("class", "x"), "class").join(sets.toDF("hub", "y"), "hub")

    def run(batches):
        for batch in batches:
            linked, short, long, outside, found = [], [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                own = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(own)) // 2
                linked.append(common * least[1] >= (len(x) + len(y) - common) * least[0])
                strict = np.floor((len(own) + c * (len(y) - len(x))) / 2 - 1e-9) + 1
                loose = np.ceil(len(own) - c * (1 + 1 / t) * len(x) - 1e-9)
                lengths = [len(own) - int(max(1, overlap)) + 1 for overlap in (strict, loose)]
                new = np.setdiff1d(x, y, assume_unique=True)
                spare = len(x) * (least[1] - least[0]) // least[1]
                if len(new) > spare:
                    own, lengths = new, [min(n, spare + 1) for n in lengths]
                else:
                    own = np.concatenate((new, np.setdiff1d(y, x, assume_unique=True)))
                short.append(lengths[0])
                long.append(lengths[1])
                outside.append(len(new))
                found.append(own)
            offsets = np.concatenate(([0], np.cumsum([len(o) for o in found]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in ("hub", "class", "component", "n")], pa.array(linked, pa.bool_()),
                 *[pa.array(v, pa.int64()) for v in (short, long, outside)], pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["hub", "class", "component", "n", "linked", "short", "long", "outside", "own"],
            )

    schema = "hub bigint, class bigint, component bigint, n bigint, linked boolean, short bigint, long bigint, outside bigint, own array<bigint>"
    rows = both.withColumn("n", F.size("x").cast("bigint")).mapInArrow(run, schema)
    tokens = rows.select("*", F.size("own").alias("size"), F.posexplode("own").alias("place", "h"))
    return tokens.withColumn("inside", F.col("place") >= F.col("outside")).drop("own", "place", "outside")


def cross_pairs(opened: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): classes of different components that met one hub and can have the similarity.

    They share one of their first differences from the hub, those outside it first and
    the rarest of them.  So a copy with changes of its own meets nothing by what is
    common to its group.
    """
    tokens = materialised(differences(opened, sets, least))
    often = materialised(tokens.groupBy("hub", "h").agg(
        F.count(F.lit(1)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).filter("lo <> hi"))
    held = skew_join(tokens, often, ["hub", "h"], counts=often.select("hub", "h", "rows"))
    own = Window.partitionBy("hub", "class")
    # differences of one component alone come first and meet no other
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    at = F.row_number().over(own.orderBy("inside", "rows", "h")) + alone
    first = held.withColumn("at", at).filter("at <= IF(linked, short, long)")
    first = materialised(first.select("hub", "h", "class", "component", "n", "linked", "at", "short"))
    other = first.toDF("hub", "h", "other", "apart", "m", "linked_too", "at_too", "short_too")
    two_free = "not linked and not linked_too and class > other and at <= short and at_too <= short_too"
    both = first.join(other, ["hub", "h"]).filter(
        (F.col("component") != F.col("apart")) & F.expr(f"(({two_free}) or (linked and not linked_too))")
    ).filter(_alike("n", "m", least))
    return both.select(*_ordered("class", "other")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs whose corrected estimate lets the similarity be possible."""
    share = least[0] / least[1] - MARGIN
    regs = classes.select("class", "regs", "n")
    seen = pairs.join(regs.toDF("a", "ra", "na"), "a").join(regs.toDF("b", "rb", "nb"), "b")

    def run(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            if len(ra):
                # few shingles make a wide estimate and a cheap check
                keep = (estimate(ra, rb, na, nb) >= share) | (np.minimum(na, nb) < BUCKETS)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return materialised(seen.mapInArrow(run, "a bigint, b bigint"))


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b) of the class pairs that have the similarity on their whole shingle sets."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * least[1] >= (len(x) + len(y) - common) * least[0])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return materialised(both.mapInArrow(exact, "a bigint, b bigint"))


def class_components(
    classes: DataFrame, docs: DataFrame, words: int, least: tuple[int, int], more: DataFrame | None = None
) -> DataFrame:
    """(class, component) of the classes that are linked; ``more`` are further candidates (a, b)."""
    met = met_hubs(shared_bands(classes))
    first = met.filter(_alike("n", "m", least)).select(*_ordered("class", "hub")).distinct()
    first = likely(first if more is None else first.union(more).distinct(), classes, least)
    either = first.select(F.col("a").alias("class")).union(first.select("b"))
    links = verified(first, whole_sets(either, classes, docs, words), least)
    groups = materialised(components(links).withColumnRenamed("node", "class"))
    opened = open_groups(met, groups)
    either = opened.select("class").union(opened.select("hub"))
    sets = whole_sets(either, classes, docs, words)
    rest = likely(cross_pairs(opened, sets, least), classes, least)
    # the components so far are stars: they take part as their edges
    return components(groups.toDF("a", "b").union(verified(rest, sets, least))).withColumnRenamed("node", "class")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows whose sets of word shingles have the Jaccard similarity ``least`` or more
    are linked; ``component_id`` is the smallest doc_id reachable, ``kept`` whether it
    is the row's own.  Null, empty and blank texts have no shingle and no link.  A row
    without doc_id is compared with nothing; its component and ``kept`` are null.
    Rows that repeat a doc_id with another text are nodes of their own.
    """
    prints = materialised(signed(docs, words))
    classes = classes_of(prints)
    groups = class_components(classes, docs.filter("doc_id is not null"), words, least)
    named = classes.select("class", "kind", "first", "rows").join(groups, "class", "left")
    named = materialised(named.withColumn("component", F.coalesce("component", "class")))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.select("kind", "component", "rows").join(firsts, "component")
    out = skew_join(
        prints.select("doc_id", "n", "kind"), names.select("kind", "component_id"), ["kind"], "left",
        counts=names.select("kind", "rows"),
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )
