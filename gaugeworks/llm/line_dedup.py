"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of their rarer lines: each
line points from a later document to the earliest document that has it, so a line
of n documents gives n - 1 links, never all pairs.  Each (later, earliest) pair is
aligned with patience diff; aligned common blocks go from the later document.

A line is a sentence or the text up to a line break (sentences of fewer than four
words go with the next one); long ones are cut further
behind words that their own hash selects, so a passage is cut alike wherever it
stands; runs of lines of fewer than four words are joined to longer ones, cut
behind lines that their hash selects.  The k-th occurrence of a line in a document
meets the k-th occurrence in another one, which makes every line unique, as patience
diff needs, and also the first one, so that a passage repeated within a document
goes each time.  What the alignment leaves goes where it is a block in itself, so a
passage that stands elsewhere in the partner goes too.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import skew_join
from ..session import materialised
from .common import slices

LINE_WORDS = 4  # shorter lines are too common to tell documents apart
LONG_WORDS = 24
BLOCK_WORDS = 20

_LINE = re.compile(r"(?:[^.!?\n]++|[.!?]++(?=[^\s.!?]))*+[.!?]*+\s*")


def _long_line(line: str) -> list[tuple[str, int]]:
    """A long line cut behind words whose own length and last letter say so."""
    out, start, at, words = [], 0, 0, 0
    for word in line.split(" "):
        at += len(word) + 1
        if word:
            words += 1
            if words >= LINE_WORDS and (7 * len(word) + ord(word[-1])) % 8 == 0 and at <= len(line):
                part = line[start:at]
                out.append((part, len(part.split())))
                start, words = at, 0
    if start < len(line):
        out.append((line[start:], len(line[start:].split())))
    return out


def _joined(lines: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Runs of short lines joined, and cut behind lines whose own hash says so."""
    out: list[tuple[str, int]] = []
    held, n = "", 0
    for line, words in lines:
        if words >= LINE_WORDS:
            if held:
                out.append((held, n))
                held, n = "", 0
            out.append((line, words))
            continue
        held, n = held + line, n + words
        if n >= LINE_WORDS and xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")) & 1:
            out.append((held, n))
            held, n = "", 0
    if held:
        out.append((held, n))
    return out


def _lines(text: str) -> list[tuple[str, int]]:
    """Lines of a text with their words; together they are the whole text."""
    out: list[tuple[str, int]] = []
    held, n = "", 0
    for line in _LINE.findall(text):
        n += len(line.split())
        if held:
            line = held + line
        if n < LINE_WORDS and "\n" not in line:
            held = line  # a short sentence goes with the next one
            continue
        if line:
            if n > LONG_WORDS:
                out += _long_line(line)
            else:
                out.append((line, n))
        held, n = "", 0
    if held:
        out.append((held, n))
    if any(k < LINE_WORDS for _, k in out):
        out = _joined(out)
    if len(out) > 1 and out[-1][1] < LINE_WORDS:  # a short end goes with what is before it
        (first, k), (last, more) = out[-2:]
        out[-2:] = [(first + last, k + more)]
    return out


def cut_lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the lines."""
    out, at = [], 0
    for line, words in _lines(text):
        out.append((at, at + len(line), words))
        at += len(line)
    return out


def line_keys(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Hashes, positions and words of the lines that have enough words.

    A line that repeats has a second hash, that of its first occurrence.  With each the hash of the short lines between it and the one before, 0 if none.
    """
    keys, places, counts, gaps, seen = [], [], [], [], {}
    digest = xxhash.xxh64_intdigest
    short: list[str] = []
    for at, (line, words) in enumerate(_lines(text)):
        if words < LINE_WORDS:
            short.append(line.strip())
            continue
        gaps.append(xxhash.xxh32_intdigest("\n".join(short).encode("utf-8", "surrogatepass")) if short else 0)
        short = []
        line = line.strip().encode("utf-8", "surrogatepass")
        key = digest(line)
        if key in seen:
            times = seen[key] = seen[key] + 1
            keys.append(key)
            places.append(at)
            counts.append(words)
            gaps.append(gaps[-1])
            key = digest(line, times)
        else:
            seen[key] = 1
        keys.append(key)
        places.append(at)
        counts.append(words)
    return keys, places, counts, gaps


def aligned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest increasing run of matched (later, earlier) positions, each used once."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _follows(lines: list[tuple[int, int, int]], last: tuple[int, int], pair: tuple[int, int], alike: bool) -> bool:
    """Whether both documents have nothing between two matched lines, or the same short lines."""
    step = pair[0] - last[0]
    if step < 1 or step != pair[1] - last[1]:
        return False
    return step == 1 or alike and all(lines[i][2] < LINE_WORDS for i in range(last[0] + 1, pair[0]))


def blocks(
    lines: list[tuple[int, int, int]], links: list[tuple[int, int, int, bool]], least: int
) -> list[tuple[int, int]]:
    """Character spans of the aligned blocks of one document.

    ``links`` has (partner, own position, partner's position, whether the short
    lines before are the partner's too).  Lines too short to be hashed belong to a
    block if they stand between two aligned lines with the same distance on both
    sides and are the same there.  Matched lines outside the alignment go where
    they follow one another in both documents and have enough words by themselves.
    """
    by: dict = {}
    same = set()
    for partner, own, other, alike in links:
        by.setdefault(partner, []).append((own, other))
        if alike:
            same.add((partner, own, other))
    gone = set()
    for partner, pairs in by.items():
        last, found = None, aligned(pairs)
        for own, other in found:
            gone.add(own)
            if last and _follows(lines, last, (own, other), (partner, own, other) in same):
                gone.update(range(last[0] + 1, own))
            last = (own, other)
        # what is left, by the distance between both places: only whole blocks
        run: list[tuple[int, int]] = []
        left = sorted(set(pairs).difference(found), key=lambda p: (p[1] - p[0], p[0]))
        for pair in [*left, (-1, -1)]:
            if run and not _follows(lines, run[-1], pair, (partner, *pair) in same):
                if sum(n for _, _, n in lines[run[0][0]: run[-1][0] + 1]) >= least:
                    gone.update(range(run[0][0], run[-1][0] + 1))
                run = []
            run.append(pair)
    spans, run = [], []
    for at in [*sorted(gone), -1]:
        if run and at != run[-1] + 1:
            if sum(lines[i][2] for i in run) >= least:
                spans.append((lines[run[0]][0], lines[run[-1]][1]))
            run = []
        run.append(at)
    return spans


def line_links(docs: DataFrame) -> DataFrame:
    """(doc_id, partner, own, other, words, alike): each shared line and its earliest holder.

    ``alike`` says whether the short lines before it are the same in both.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in slices(batches):
            key, at, words, gap, sizes = [], [], [], [], []
            for t in texts:
                k, p, n, g = line_keys(t)
                key += k
                at += p
                words += n
                gap += g
                sizes.append(len(k))
            owner = np.repeat(np.arange(len(texts)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(np.array(key, np.uint64).view(np.int64)),
                    pa.array(at, pa.int32()),
                    pa.array(words, pa.int32()),
                    pa.array(np.array(gap, np.uint32).view(np.int32)),
                ],
                ["doc_id", "line", "at", "words", "gap"],
            )

    lines = materialised(
        docs.filter("doc_id is not null and text is not null")
        .select("doc_id", "text")
        .mapInArrow(run, f"doc_id {kind}, line bigint, at int, words int, gap int")
    )
    # only lines of several documents; written once, as both the join and its hot keys read it
    first = materialised(
        lines.groupBy("line").agg(
            F.min(F.struct("doc_id", "at", "gap")).alias("first"), F.max("doc_id").alias("last"),
            F.count(F.lit(1)).alias("rows"),
        ).filter("last > first.doc_id").drop("last")
    )
    earliest = first.select("line", F.col("first.doc_id").alias("partner"), F.col("first.at").alias("other"), F.col("first.gap").alias("before"))
    out = skew_join(lines, earliest, ["line"], counts=first.select("line", "rows"))
    return out.filter("doc_id > partner").select(
        "doc_id", "partner", F.col("at").alias("own"), "other", "words", (F.col("gap") == F.col("before")).alias("alike")
    )


def dedup_lines(
    docs: DataFrame, *, block_words: int = BLOCK_WORDS, removed: str = "removed", spans: str = "spans"
) -> DataFrame:
    """Input columns, with the blocks an earlier document has gone from ``text``.

    Adds ``removed``, the number of removed characters, and ``spans``, their
    (start, stop) in the old text; both replace any column of that name.  Null and
    empty texts come back as they are.  Rows without doc_id have no place in the
    order and stay as they are.  Rows that repeat a doc_id are one document and
    lose the same lines.  Blocks of fewer than ``block_words`` words stay.
    """
    plain = docs.drop(removed, spans)
    # a document with fewer shared words than one block needs can not lose any
    marks = line_links(docs).groupBy("doc_id").agg(
        F.collect_set(F.struct("partner", "own", "other", "alike")).alias("__links"), F.sum("words").alias("words")
    ).filter(F.col("words") >= block_words).select(F.col("doc_id").alias("__marked"), "__links")
    joined = plain.join(marks, plain["doc_id"] == marks["__marked"], "left").select(*plain.columns, "__links")
    span = "array<struct<start: bigint, stop: bigint>>"
    schema = plain.withColumn(removed, F.lit(0).cast("bigint")).withColumn(spans, F.lit(None).cast(span)).schema
    at_text = plain.columns.index("text")

    def run(batches):
        for batch, texts in slices(batches):
            known = batch.column("text").is_valid().to_pylist()
            out, gone, cuts = [], [], []
            for text, links, valid in zip(texts, batch.column("__links").to_pylist(), known):
                cut = []
                if links:
                    cut = blocks(cut_lines(text), [(r["partner"], r["own"], r["other"], r["alike"]) for r in links], block_words)
                kept, at = [], 0
                for a, b in cut:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append("".join(kept) if valid else None)
                gone.append(sum(b - a for a, b in cut))
                cuts.append([{"start": a, "stop": b} for a, b in cut])
            columns = list(batch.columns[:-1])
            columns[at_text] = pa.array(out, pa.string())
            columns += [
                pa.array(gone, pa.int64()),
                pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
