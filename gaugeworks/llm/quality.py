"""Quality classifier: perplexity under an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model of five characters per
language, so it has no unknown words and sees case, markup and symbols.  All
trusted text is counted; counts are summed on the map side and sharded by the
third and fourth character, which all orders from three on of one position share.
So a shard holds everything its positions need, its part of the model is computed
in one task, and scoring joins documents with the shards in chunks of a counted
size.  Limits per language and length class come from held-out trusted text.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import code_points, semi_join, slices, sums

ORDER = 5
SHARDS = 64
CHUNK_ENTRIES = 4_000_000  # 12 bytes each
UPPER = 0.98
MARGIN = 0.5
HELD_KEYS = 1_000_000  # distinct windows a task holds per language before it sends them on
LEAST = 30  # held-out documents that a length class needs for limits of its own

_BITS = 12
_PAD = 1
_VOCABULARY = 1 << _BITS
_CONTEXT = 8  # tag of back-off weights, added to the order


def _mask(order: int) -> int:
    return (1 << (_BITS * order)) - 1


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed five-character windows of the texts and the bounds of each text.

    White space counts as one blank.  Code points from 3,840 on are folded into
    256 classes.
    """
    spaced = [" ".join(t.split()) for t in texts]
    pad = chr(_PAD) * (ORDER - 1)
    points, _ = code_points([pad + s for s in spaced])
    codes = np.where(points < 3840, points, 3840 + points % 256).astype(np.int64)
    key = np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        key[k:] |= codes[: len(codes) - k] << (_BITS * k)
    sizes = np.fromiter((len(s) for s in spaced), np.int64, len(spaced))
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    return key[at], bounds


def _merged(key, n, more_key, more_n):
    """Sum of two sorted count lists."""
    every = np.union1d(key, more_key)
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, key)] += n
    total[np.searchsorted(every, more_key)] += more_n
    return every, total


def count_ngrams(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, key, n): windows of every text, counted in each task before the shuffle."""

    def rows_of(name, key, n):
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(name, pa.string()), len(key)), pa.array(key), pa.array(n)], ["lang", "key", "n"]
        )

    def run(batches):
        held: dict = {}
        for batch, texts in slices(batches, 1_000_000):
            langs = batch.column("lang").to_pylist()
            for name in sorted(set(langs)):
                key, _ = _keys([t for t, own in zip(texts, langs) if own == name])
                key, n = np.unique(key, return_counts=True)
                if name in held:
                    key, n = _merged(*held[name], key, n)
                held[name] = key, n
                if len(key) > HELD_KEYS:
                    yield rows_of(name, *held.pop(name))
        for name, (key, n) in held.items():
            yield rows_of(name, key, n)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), "text").filter("text is not null")
    return rows.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _shard() -> Column:
    return F.pmod(F.xxhash64(F.shiftright("key", _BITS).bitwiseAND(F.lit(_mask(2)))), F.lit(SHARDS)).cast("int")


def _orders(key: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts per order of one shard: continuation counts below the top."""
    at = np.argsort(key)
    out = {ORDER: (key[at], n[at])}
    for order in (4, 3, 2):
        out[order] = np.unique(out[order + 1][0] & _mask(order), return_counts=True)
    return out


def _statistics(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of counts of the upper orders, and the shard's share of the bigrams."""
    orders = _orders(rows["key"].to_numpy(), rows["n"].to_numpy())
    parts = [
        pd.DataFrame({"order": o, "key": k, "n": [int((orders[o][1] == k).sum()) for k in range(1, 5)]})
        for o in (5, 4, 3) for k in [range(1, 5)]
    ]
    parts.append(pd.DataFrame({"order": 2, "key": orders[2][0], "n": orders[2][1]}))
    return pd.concat(parts).assign(lang=rows["lang"].iloc[0])[["lang", "order", "key", "n"]]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from n1 .. n4."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)])


def _level(key, n, cut, lower):
    """Probabilities of sorted grams, and contexts with their back-off weight."""
    context = key >> _BITS
    starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    total = np.add.reduceat(n, starts).astype(float)
    taken = cut[np.minimum(n, 3) - 1]
    weight = np.add.reduceat(taken, starts) / total
    p = (n - taken) / np.repeat(total, sizes) + np.repeat(weight, sizes) * lower
    return p, context[starts], weight


def _low_orders(key: np.ndarray, n: np.ndarray) -> dict:
    """Bigrams and unigrams of a language, from the continuation counts of its bigrams."""
    at = np.argsort(key)
    key, n = key[at], n[at]
    letters, types = np.unique(key & _mask(1), return_counts=True)
    cuts = discounts([int((types == k).sum()) for k in range(1, 5)])
    taken = cuts[np.minimum(types, 3) - 1]
    total = types.sum()
    rest = taken.sum() / total / _VOCABULARY
    one = (types - taken) / total + rest
    cuts = discounts([int((n == k).sum()) for k in range(1, 5)])
    two, context, weight = _level(key, n, cuts, one[np.searchsorted(letters, key & _mask(1))])
    return {"two": (key, two), "context": (context, weight), "one": (letters, one), "rest": rest}


def _tagged(tag: int, key: np.ndarray) -> np.ndarray:
    """Key with its kind in the top bits, as the signed number with those bits."""
    return (key.astype(np.uint64) | np.uint64(tag << 60)).view(np.int64)


def _shard_model(rows: pd.DataFrame, cuts: dict, low: dict) -> pd.DataFrame:
    """Log probabilities and back-off weights of one shard."""
    lang = rows["lang"].iloc[0]
    orders = _orders(rows["key"].to_numpy(), rows["n"].to_numpy())
    keys, values = [], []
    below_key, below = low[lang]["two"]
    for order in (3, 4, 5):
        key, n = orders[order]
        lower = below[np.searchsorted(below_key, key & _mask(order - 1))]
        p, context, weight = _level(key, n, cuts[lang, order], lower)
        keys += [_tagged(order, key), _tagged(_CONTEXT + order, context)]
        values += [np.log(p), np.log(weight)]
        below_key, below = key, p
    return pd.DataFrame({
        "lang": lang, "shard": rows["shard"].iloc[0], "key": np.concatenate(keys),
        "value": np.concatenate(values).astype(np.float32),
    })


class Model:
    """Sharded model table (lang, shard, key, value) and the small low orders."""

    def __init__(self, table: DataFrame, low: dict, entries: list[tuple[str, int, int]]):
        self.table, self.low, self.entries = table, low, entries

    def chunks(self):
        """Shards in groups of at most ``CHUNK_ENTRIES`` entries."""
        size, chunk = 0, []
        for lang, shard, n in self.entries:
            if chunk and size + n > CHUNK_ENTRIES:
                yield chunk
                size, chunk = 0, []
            chunk.append((lang, shard))
            size += n
        if chunk:
            yield chunk


def train(trusted: DataFrame, lang: str = "lang") -> Model:
    """Count all trusted text and build the sharded model.

    The driver gets counts of counts and bigram counts (at most the square of the
    4,096 letter classes per language), never the n-gram table.
    """
    counts = materialised(count_ngrams(trusted, lang).withColumn("shard", _shard()))
    grouped = counts.groupBy("lang", "shard")
    found: dict = {}
    summed = grouped.applyInPandas(_statistics, "lang string, order int, key bigint, n bigint").groupBy(
        "lang", "order", "key"
    ).agg(F.sum("n").alias("n"))
    for (name, order), part in summed.toArrow().to_pandas().groupby(["lang", "order"]):
        found[name, int(order)] = (part["key"].to_numpy(), part["n"].to_numpy())
    cuts, low = {}, {}
    for (name, order), (key, n) in found.items():
        if order == 2:
            low[name] = _low_orders(key, n)
        else:
            cuts[name, order] = discounts(n[np.argsort(key)].tolist())
    table = materialised(
        grouped.applyInPandas(
            lambda rows: _shard_model(rows, cuts, low), "lang string, shard int, key bigint, value float"
        )
    )
    sizes = {(r["lang"], r["shard"]): r["count"] for r in table.groupBy("lang", "shard").count().collect()}
    # empty shards too: their positions back off to the low orders
    return Model(table, low, [(name, k, sizes.get((name, k), 0)) for name in sorted(low) for k in range(SHARDS)])


def _loaded(model: Model, chunk: list[tuple[str, int]]) -> dict:
    """Sorted arrays of one chunk per language, with the shards it covers."""
    wanted = model.table.sparkSession.createDataFrame(chunk, "lang string, shard int")
    rows = model.table.join(F.broadcast(wanted), ["lang", "shard"]).select("lang", "key", "value").toArrow().to_pandas()
    out = {}
    for lang in {name for name, _ in chunk}:
        part, low = rows[rows["lang"] == lang], model.low[lang]
        key = np.concatenate([
            part["key"].to_numpy(), _tagged(2, low["two"][0]), _tagged(_CONTEXT + 2, low["context"][0]),
            _tagged(1, low["one"][0]),
        ]).view(np.uint64)
        value = np.concatenate([
            part["value"].to_numpy(), np.log(low["two"][1]), np.log(low["context"][1]), np.log(low["one"][1])
        ]).astype(np.float32)
        at = np.argsort(key)
        out[lang] = (key[at], value[at], np.float32(np.log(low["rest"])), [s for name, s in chunk if name == lang])
    return out


def _places(distinct: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted distinct keys, by hashing (much cheaper than a sort with indices)."""
    bits = np.uint64(64 - max(10, int(len(distinct) * 8).bit_length()))
    out = np.zeros(len(key), np.int64)
    left, ask = np.arange(len(distinct)), None
    factor = 0x9E3779B97F4A7C15
    while len(left):
        mixed = np.uint64(factor)
        table = np.zeros(1 << (64 - int(bits)), np.int64)
        slot = (distinct[left].astype(np.uint64) * mixed) >> bits
        table[slot] = left
        own = key if ask is None else key[ask]
        got = table[(own.astype(np.uint64) * mixed) >> bits]
        same = distinct[got] == own
        if ask is None:
            out = got
            ask = np.flatnonzero(~same)
        else:
            out[ask[same]] = got[same]
            ask = ask[~same]
        left = left[table[slot] != left]  # lost their slot to another key
        factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
    return out


def _log_probabilities(key: np.ndarray, table) -> np.ndarray:
    """Log probability of the last character of each window, backing off where unseen."""
    known, values, rest, _ = table

    def find(tag, own):
        tagged = own.astype(np.uint64) | np.uint64(tag << 60)
        at = np.minimum(np.searchsorted(known, tagged), len(known) - 1)
        return values[at], known[at] == tagged

    out = np.zeros(len(key), np.float64)
    left = np.arange(len(key))
    for order in range(ORDER, 0, -1):
        value, hit = find(order, key[left] & _mask(order))
        out[left[hit]] += value[hit]
        left = left[~hit]
        if order > 1 and len(left):
            value, hit = find(_CONTEXT + order, (key[left] & _mask(order)) >> _BITS)
            out[left[hit]] += value[hit]
    out[left] += rest
    return out


def score(docs: DataFrame, model: Model, lang: str = "lang") -> DataFrame:
    """Input rows with ``__logp`` and ``__size``: log probability and characters.

    Languages without a model have null.  Each chunk of the model is broadcast and
    adds the positions of its shards.
    """
    rows = docs.withColumn("__logp", F.lit(None).cast("double")).withColumn("__size", F.lit(0).cast("bigint"))
    spark = docs.sparkSession
    chunks = list(model.chunks())
    for chunk in chunks:
        shared = spark.sparkContext.broadcast(_loaded(model, chunk))
        whole = len(chunks) == 1

        def run(batches, shared=shared, whole=whole):
            tables = shared.value
            for batch, texts in slices(batches, 1_000_000):
                langs = [x or "" for x in batch.column("__lang").to_pylist()]
                logp = batch.column("__logp").to_pylist()
                size = batch.column("__size").to_pylist()
                order = sorted(range(len(langs)), key=lambda i: langs[i])
                for name, own in groupby(order, key=lambda i: langs[i]):
                    if name not in tables:
                        continue
                    own = list(own)
                    key, bounds = _keys([texts[i] for i in own])
                    distinct = np.unique(key)
                    value = _log_probabilities(distinct, tables[name])
                    if not whole:
                        value[~np.isin(_shards(distinct), tables[name][3])] = 0
                    total = sums(value[_places(distinct, key)], bounds)
                    for i, x, n in zip(own, total.tolist(), np.diff(bounds).tolist()):
                        logp[i], size[i] = (logp[i] or 0.0) + x, n
                columns = [*batch.columns[:-2], pa.array(logp, pa.float64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        kept = rows.select(
            *docs.columns, F.col(lang).cast("string").alias("__lang"), "__logp", "__size"
        )
        rows = kept.mapInArrow(run, kept.schema).drop("__lang")
        if not whole:
            rows = materialised(rows)
    return rows


def _shards(key: np.ndarray) -> np.ndarray:
    """The shard of each window, as the table has it (xxhash64 of the middle pair)."""
    import xxhash

    pairs, at = np.unique((key >> _BITS) & _mask(2), return_inverse=True)
    own = [
        int(np.uint64(xxhash.xxh64_intdigest(int(p).to_bytes(8, "little"), 42)).view(np.int64)) % SHARDS for p in pairs
    ]
    return np.array(own, np.int64)[at]


def _class() -> Column:
    """Length class: the power of four of the number of characters."""
    return F.floor(F.log(4.0, F.greatest(F.col("__size"), F.lit(1)))).cast("int")


def limits(held_out: DataFrame) -> DataFrame:
    """(lang, class, high) from held-out trusted documents; class -1: all lengths.

    ``high`` is a quantile of the log perplexity, moved out by ``MARGIN`` of its
    distance from the median, so that clean text next to the quantile stays.
    """
    rows = held_out.filter("__logp is not null and __size > 0").select(
        F.coalesce("lang", F.lit("")).alias("lang"), _class().alias("class"), (-F.col("__logp") / F.col("__size")).alias("x")
    )
    q = F.percentile_approx("x", F.array(F.lit(0.5), F.lit(UPPER)), F.lit(10_000)).alias("q")
    each = rows.groupBy("lang", "class").agg(q, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    every = rows.groupBy("lang").agg(q).select("lang", F.lit(-1).alias("class"), "q")
    mid, high = F.col("q")[0], F.col("q")[1]
    return each.select("lang", "class", "q").union(every).select(
        "lang", "class", (high + MARGIN * (high - mid)).alias("high")
    )


def classify(
    docs: DataFrame, trusted: DataFrame, *, perplexity: str = "perplexity", accepted: str = "accepted"
) -> DataFrame:
    """Input columns plus ``perplexity`` and ``accepted``, which replace any of that name.

    ``docs`` has doc_id, text and lang; ``trusted`` has the ids of trusted
    documents.  Four fifths of the trusted text train the model, the rest sets the
    limits.  A document is rejected if its perplexity is above the limit of its
    language and length class.  Null, empty and blank texts and languages without a trusted
    document have null perplexity and are accepted; a null language is a language
    of its own.  Repeated rows give repeated results.
    """
    known = semi_join(docs.select("doc_id", "text", "lang"), trusted.select("doc_id"), "doc_id")
    split = F.pmod(F.xxhash64("text"), F.lit(5))
    model = train(known.filter(split != 0))
    plain = docs.drop(perplexity, accepted)
    bounds = materialised(limits(score(known.filter(split == 0), model)))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    # a limit per language and length class: a few rows
    one = F.broadcast(bounds.filter("class >= 0").selectExpr("lang as __l1", "class as __c1", "high as __h1"))
    every = F.broadcast(bounds.filter("class < 0").selectExpr("lang as __l2", "high as __h2"))
    x = F.when(F.col("__size") > 0, -F.col("__logp") / F.col("__size"))
    out = (
        score(plain, model).withColumn("__x", x).withColumn("__c", _class())
        .join(one, (lang == F.col("__l1")) & (F.col("__c") == F.col("__c1")), "left")
        .join(every, lang == F.col("__l2"), "left")
    )
    return out.select(
        *plain.columns,
        F.exp("__x").alias(perplexity),
        F.coalesce(F.col("__x") <= F.coalesce("__h1", "__h2"), F.lit(True)).alias(accepted),
    )
