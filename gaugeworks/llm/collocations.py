"""Phrases that belong together: a weighted de Bruijn graph of words.

Nodes are three words that follow one another in a piece of text, edges four.
Every word position gives one row: the edge that starts there or, at the end of a
piece, what is left of it.  So the edges and these ends hold the shorter counts:
a node has the flow of the edges that leave it plus the pieces that end with it,
two words that of the nodes they begin plus their ends.

A word of fewer than ``least`` occurrences is in no phrase that counts, so pieces are
cut at such words.  Tasks know them by a bit table of fixed size; a word that is
taken for a frequent one costs a row and changes nothing.

Where all that passes a node comes in by one edge and leaves by one, the two edges
are joined to a path.  All windows of a path occur as often as the path; the nodes
inside it are never phrases of their own, since four words hold all their occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import positions
from ..session import materialised
from .common import slices

LEAST = 30
ORDER = 4  # words of an edge
TOP = 2000
SCALE = 2_000_000
SHARE = 80  # percent of a phrase's occurrences that lie in one longer phrase
HOT_SHARE, SALTS = 1024, 64  # a word is hot beyond one in so many; parts of a pair of hot words
BITS = 1 << 26  # of the bit table of frequent words, 8 MB
_SEED = 42  # of xxhash64 in Spark SQL
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BLANK = b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[list(_BLANK)] = 1
_KIND[list(_SEPARATORS)] = 2


class Words:
    """Words of a slice of texts: bytes, places, distinct ids, pieces and texts."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
        kind = _KIND[raw]
        word = kind == 0
        first = word & ~np.concatenate(([False], word[:-1]))
        starts = np.flatnonzero(first)
        self.piece = np.cumsum(kind == 2)[starts]
        ends = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
        self.text = np.searchsorted(ends, starts, side="right") - 1
        # every word and one blank behind it
        kept = word | np.concatenate(([False], word[:-1]))
        self.raw = np.where(word, raw, np.uint8(32))[kept]
        self.at = np.cumsum(kept)[starts] - 1
        self.end = np.append(self.at[1:], len(self.raw)) - 1  # behind the last byte of the word
        # the blank belongs to the item, so items fill the buffer without gaps
        bounds = np.append(self.at, len(self.raw)).astype(np.int32)
        items = pa.BinaryArray.from_buffers(pa.binary(), len(self.at), [None, pa.py_buffer(bounds), pa.py_buffer(self.raw)])
        encoded = items.dictionary_encode()
        self.ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = [w[:-1] for w in encoded.dictionary.to_pylist()]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Byte ranges as strings."""
        sizes = ends - starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    encoded = batch.column("lang").fill_null("und").dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted_words(batches):
    for batch, texts in slices(batches):
        names, lang = _languages(batch)
        words = Words(texts)
        code, n = np.unique(words.ids * len(names) + lang[words.text], return_counts=True)
        which = pa.array(words.distinct, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(code % len(names))), which.take(pa.array(code // len(names))), pa.array(n)],
            ["lang", "word", "n"],
        )


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of every word per language."""
    rows = docs.select("lang", "text").mapInArrow(_counted_words, "lang string, word string, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_bits(words: DataFrame, least: int) -> np.ndarray:
    """Bit table of the hashes of frequent words, of a fixed size whatever their number."""
    place = F.pmod(F.xxhash64("lang", "word"), F.lit(BITS)) + 1
    rows = words.filter(F.col("n") >= least).select(
        F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    table = np.zeros(BITS, bool)
    for row in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        table[(row.bucket - 1) * len(bits): row.bucket * len(bits)] = bits
    return np.packbits(table, bitorder="little")


def hot_words(words: DataFrame) -> list[tuple[str, str]]:
    """(lang, word) of the words that are more than one in ``HOT_SHARE`` of all: at most that many."""
    total = words.agg(F.sum("n")).first()[0] or 0
    return [(r.lang, r.word) for r in words.filter(F.col("n") * HOT_SHARE > total).select("lang", "word").collect()]


def edges(docs: DataFrame, bits: np.ndarray, hot: list[tuple[str, str]]) -> DataFrame:
    """(part, key, n): edges, and what is left of them at the end of a piece.

    A key has a language, the first two words, the third and the fourth, one per line;
    the last two may be empty.  Equal rows of a slice are one.  Keys that agree in the
    first two words have the same ``part``; those of two hot words are dealt
    out further by their third.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits, frozenset(hot)))

    def run(batches):
        table, often = shared.value
        for batch, texts in slices(batches):
            names, lang = _languages(batch)
            words = Words(texts)
            own = lang[words.text]
            none = len(words.distinct)
            keep, busy = np.zeros(len(words.ids), bool), np.zeros(len(words.ids), bool)
            hashed = np.zeros((len(names), none), np.uint64)
            for k, name in enumerate(names):
                seed = xxhash.xxh64_intdigest(name.encode(), _SEED)
                hashed[k] = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.distinct), np.uint64, none)
                place = hashed[k].view(np.int64) % BITS
                known = (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                keep |= known[words.ids] & (own == k)
                hot_here = {w.encode() for x, w in often if x == name}
                if hot_here:
                    busy |= np.fromiter((w in hot_here for w in words.distinct), bool, none)[words.ids] & (own == k)
            held = np.flatnonzero(keep)
            n = len(held)
            if not n:
                continue
            piece = words.piece[held]
            breaks = np.flatnonzero(np.concatenate(([True], (np.diff(held) > 1) | (np.diff(piece) > 0))))
            left = np.repeat(np.append(breaks[1:], n), np.diff(np.append(breaks, n))) - np.arange(n)
            at = np.flatnonzero(left > 1)  # a word alone begins no phrase
            if not len(at):
                continue
            size = np.minimum(left[at], ORDER)
            ids = np.concatenate((words.ids[held], np.full(ORDER, none)))
            each = [np.where(size > k, ids[at + k], none) for k in range(ORDER)]
            pairs = np.concatenate((each[0] * (none + 1) + each[1], each[2] * (none + 1) + each[3]))
            distinct, dense = np.unique(pairs, return_inverse=True)
            code = (dense[: len(at)] * len(distinct) + dense[len(at):]) * len(names) + own[held[at]]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            size, start = size[first], held[at[first]]
            value = hashed[own[start], words.ids[start]] * np.uint64(3) ^ hashed[own[start], words.ids[start + 1]]
            salted = busy[start] & busy[start + 1] & (size > 2)
            third = np.where(size > 2, start + 2, start)
            value = np.where(salted, value ^ (hashed[own[start], words.ids[third]] % np.uint64(SALTS) + np.uint64(1)), value)
            part = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            head = words.spans(words.at[start], words.end[start + 1])
            rest = []
            for k in (2, 3):
                there = np.where(size > k, start + k, 0)
                rest.append(words.spans(words.at[there], np.where(size > k, words.end[there], words.at[there])))
            label = pa.array(names, pa.string()).take(pa.array(own[start]))
            key = pc.binary_join_element_wise(label, head, *rest, "\n")
            yield pa.RecordBatch.from_arrays([pa.array(part), key, pa.array(count)], ["part", "key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "part int, key string, n bigint")


def _flows(least: int, hot: frozenset):
    """Sums over a stream sorted by part and key: edges, nodes and pairs that occur ``least`` times.

    A node has the flow of its edges and the ends with it, a pair that of its nodes and
    its ends.  Pairs of two hot words are given as parts of a sum.
    """

    def run(batches):
        pending: dict[int, tuple] = {}

        def given(rows):
            lang, phrase, size, n, part = zip(*rows) if rows else ((), (), (), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64()),
                 pa.array(part, pa.bool_())], ["lang", "phrase", "size", "n", "part"])

        def result(size, words, n):
            lang, head, third, last = words
            whole = size == 2 and all((lang, w) in hot for w in head.split(" "))
            if whole or n >= least and (size < 3 or third) and (size < 4 or last):
                phrase = " ".join([head, third, last][: size - 1])
                return [(lang, phrase, size, int(n), whole)]
            return []

        for batch in batches:
            if not len(batch):
                continue
            parts = pc.list_flatten(pc.split_pattern(batch.column("key"), "\n"))
            columns = [parts.take(pa.array(np.arange(k, len(parts), 4))) for k in range(4)]
            n = batch.column("n").to_numpy()
            part = batch.column("part").to_numpy()
            change = np.zeros(len(batch) - 1, bool)
            out = []
            change |= np.diff(part) != 0
            for size, upto in ((2, (0, 1)), (3, (2,)), (4, (3,))):
                for k in upto:
                    change = change | np.asarray(pc.not_equal(columns[k][1:], columns[k][:-1]))
                starts = np.concatenate(([0], np.flatnonzero(change) + 1))
                sums = np.add.reduceat(n, starts)

                def words_at(i, size=size):
                    return tuple(columns[k][int(i)].as_py() if k < size else "" for k in range(4))

                first = (int(part[0]), words_at(0))
                if size in pending:
                    before, total = pending[size]
                    if before == first:
                        sums[0] += total
                    else:
                        out += result(size, before[1], total)
                pending[size] = ((int(part[-1]), words_at(starts[-1])), int(sums[-1]))
                wanted = sums[:-1] >= least
                if size == 2 and hot and len(wanted):
                    wanted |= _both_hot(columns, starts[:-1], hot)
                for g in np.flatnonzero(wanted):
                    out += result(size, words_at(starts[g]), sums[g])
            yield given(out)
        yield given([r for size, (key, total) in pending.items() for r in result(size, key[1], total)])

    return run


def _both_hot(columns: list[pa.Array], starts: np.ndarray, hot: frozenset) -> np.ndarray:
    """Whether the pairs at these rows are of two hot words."""
    lang, head = (c.take(pa.array(starts)) for c in columns[:2])
    words = pc.split_pattern(head, " ")
    known = pa.array(sorted(f"{x}\n{w}" for x, w in hot), pa.string())
    both = [pc.is_in(pc.binary_join_element_wise(lang, pc.list_element(words, k), "\n"), known) for k in (0, 1)]
    return np.asarray(pc.and_(*both))


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of all phrases of up to four words that occur often enough, (lang, n) of all words)."""
    words = materialised(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    hot = hot_words(words)
    rows = edges(docs, frequent_bits(words, least), hot)
    # one shuffle: all that begins with the same two words meets in order
    dealt = rows.repartition("part").sortWithinPartitions("part", "key")
    schema = "lang string, phrase string, size int, n bigint, part boolean"
    found = materialised(dealt.mapInArrow(_flows(least, frozenset(hot)), schema))
    shared = found.filter("part").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # single words were counted for the bit table
    one = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return materialised(found.filter("not part").drop("part").union(shared).union(one)), totals


def _first(phrase: str, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def paths(counts: DataFrame) -> DataFrame:
    """(lang, phrase, n, inside): compacted paths of the graph, and the nodes inside them.

    An edge goes on to the next one where both hold all occurrences of the node
    between.  Each edge learns the first edge of its path and its distance by
    doubling, in as many rounds as the logarithm of the longest path.
    """
    long = counts.filter("size = 4").select(
        "lang", F.col("phrase").alias("edge"), _first("phrase", 3).alias("from"),
        F.substring_index("phrase", " ", -3).alias("to"), "n",
    )
    nodes = counts.filter("size = 3").select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    into = long.join(nodes, (long["to"] == nodes["node"]) & (long["lang"] == nodes["lang"]) & (F.col("n") == F.col("flow")))
    into = into.select(long["lang"], F.col("edge").alias("before"), "node")
    follows = long.join(nodes, (long["from"] == nodes["node"]) & (long["lang"] == nodes["lang"]) & (F.col("n") == F.col("flow")))
    follows = follows.select(long["lang"], "edge", "node")
    joined = materialised(follows.join(into, ["lang", "node"]).select("lang", "edge", "before", "node"))
    # (edge, head, steps): the edge so many steps before, until it is one without a predecessor
    state = materialised(
        long.join(joined, ["lang", "edge"], "left")
        .select("lang", "edge", "n", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps"))
    )
    while True:
        back = state.select("lang", F.col("edge").alias("head"), F.col("head").alias("__head"), F.col("steps").alias("__steps"))
        then = materialised(
            state.join(back, ["lang", "head"]).select("lang", "edge", "n", F.col("__head").alias("head"), (F.col("steps") + F.col("__steps")).alias("steps"))
        )
        if then.agg(F.sum("steps")).first() == state.agg(F.sum("steps")).first():
            break
        state = then
    place = F.sort_array(F.collect_list(F.struct("steps", F.substring_index("edge", " ", -1).alias("word"))))
    whole = state.groupBy("lang", "head", "n").agg(place.alias("p"))  # at most as long as a piece of text
    tail = F.transform(F.slice("p", 2, F.size("p")), lambda x: x["word"])
    return whole.select("lang", F.concat_ws(" ", F.array("head"), tail).alias("phrase"), "n")


def graph_counts(counts: DataFrame, whole: DataFrame) -> DataFrame:
    """(lang, phrase, size, n, inside) with edges and the nodes inside paths taken from the paths."""
    words = whole.select("lang", "n", F.split("phrase", " ").alias("w"))

    def windows(size: int, low: int, off: int) -> DataFrame:
        some = words.filter(F.size("w") >= size + low + off)
        at = some.select("lang", "n", "w", F.explode(F.sequence(F.lit(low), F.size("w") - size - off)).alias("i"))
        phrase = F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(size)])
        return at.select("lang", phrase.alias("phrase"), F.lit(size).alias("size"), "n", F.lit(size == 3).alias("inside"))

    inner = windows(3, 1, 1)
    ends = counts.filter("size = 3").join(inner.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    rest = ends.union(counts.filter("size < 3")).withColumn("inside", F.lit(False))
    return windows(4, 0, 0).union(inner).union(rest.select("lang", "phrase", "size", "n", "inside"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two to four words that no path encloses, by their weakest cut."""
    phrases = counts.filter("size > 1 and not inside").withColumnRenamed("n", "a")
    cut = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("x", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "y", F.expr("substring_index(phrase, ' ', k - size)"))
    parts = counts.select("lang", "phrase", "n")
    cut = cut.join(parts.toDF("lang", "x", "l"), ["lang", "x"]).join(parts.toDF("lang", "y", "r"), ["lang", "y"])
    exact = F.expr(f"(cast(a as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div (cast(l as decimal(20, 0)) + r)")
    ranked = cut.select("lang", "phrase", "size", "a", F.struct(exact.alias("score"), "k", "l", "r").alias("cut"))
    least = ranked.groupBy("lang", "phrase", "size", "a").agg(F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def unenclosed(phrases: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """Phrases that lie in no longer one with ``share`` percent or more of their occurrences."""
    longer = counts.filter("size > 2").select("n", "lang", "size", F.split("phrase", " ").alias("w"))
    cut = longer.select("lang", "n", "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    cut = cut.select("lang", "n", "w", "part", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("i"))
    inner = cut.select("lang", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("part"))).alias("phrase"), "n")
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    joined = phrases.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.coalesce(F.col("most") * 100 < F.col("a") * share, F.lit(True))).drop("most")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks
    and tabs, A-Z in lower case.  Null and empty texts have no word, a null language
    is ``und``.  Phrases of two to four words with ``least`` or more occurrences ``a``
    count; a cut into parts of ``l`` and ``r`` occurrences scores 2000000 a / (l + r),
    rounded down, and of equal cuts the first counts.  A phrase inside a longer one with
    80 % or more of its occurrences is left out.  Rows that repeat count each time.
    """
    found, totals = phrase_counts(docs, least)
    counts = materialised(graph_counts(found, materialised(paths(found))))
    left = unenclosed(scored(counts), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = positions(left, ["lang"], order, "rank").filter(F.col("rank") < top)
    return ranked.join(totals, "lang").select(
        "lang", (F.col("rank") + 1).cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


#: DuckDB twin of ``collocations`` over documents: every phrase counted by itself.
SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS parts
    FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i
          FROM words, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size)),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
counts AS (SELECT lang, size, phrase, parts, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.size, c.f AS a, k, x.f AS l, y.f AS r,
           CAST((CAST(2000000 AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1:k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[k + 1:], ' ')),
weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT lang, array_to_string(parts[i:i + len - 1], ' ') AS phrase, max(f) AS most
    FROM (SELECT lang, parts, f, len, unnest(range(1, size - len + 2)) AS i
          FROM (SELECT *, unnest(range(2, size)) AS len FROM counts WHERE size > 2))
    GROUP BY ALL),
kept AS (
    SELECT w.* FROM weakest w LEFT JOIN inner_phrases i USING (lang, phrase)
    WHERE i.most IS NULL OR i.most * 100 < w.a * 80),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
