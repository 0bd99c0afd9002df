"""Token counts per section from one encoding of the whole document.

A document is encoded once; the byte lengths of its tokens give their spans.
Sections are character spans of the text.  An interval join of the two sorted
span lists gives each token to one section.  A token that crosses a boundary goes
to the section that has most of its bytes, on a tie to the earlier one.
Characters of no section belong to the section ``REST``.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

REST = "(rest)"
Sections = list[tuple[str, int, int]]


class ByteEncoder:
    """Whole-text encoding with a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def sizes_of(self, text: str) -> np.ndarray:
        """Bytes of each token of the text."""
        return self.sizes[self.encoding.encode_ordinary(text)]


def line_sections(text: str) -> Sections:
    """One section per line, named by its number from 0; a line break ends its line."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((str(i), at, end))
        at = end
    return out


def tiles(sections: Sections, size: int) -> Sections:
    """Sections cut to the text, in order, with the gaps between them as ``REST``.

    Where sections overlap, the one that starts first keeps the shared characters
    (on a tie the first name).
    """
    out, at = [], 0
    for name, start, stop in sorted(sections, key=lambda s: (s[1], s[0], s[2])):
        start, stop = max(start, at), min(stop, size)
        if start >= stop:
            continue
        if start > at:
            out.append((REST, at, start))
        out.append((name, start, stop))
        at = stop
    if at < size:
        out.append((REST, at, size))
    return out


def attribute(sizes: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per tile and boundary-crossing tokens among them.

    ``sizes`` are the bytes of the tokens, ``starts`` the first byte of each tile.
    """
    n = np.zeros(len(starts), np.int64)
    crossing = np.zeros(len(starts), np.int64)
    if not len(sizes):
        return n, crossing
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(starts, start, side="right") - 1
    last = np.searchsorted(starts, stop - 1, side="right") - 1
    inside = first == last
    n += np.bincount(first[inside], minlength=len(starts))
    edges = np.append(starts, total)
    for t in np.flatnonzero(~inside):
        tiles_of = np.arange(first[t], last[t] + 1)
        share = np.minimum(edges[tiles_of + 1], stop[t]) - np.maximum(edges[tiles_of], start[t])
        own = tiles_of[np.argmax(share)]
        n[own] += 1
        crossing[own] += 1
    return n, crossing


def _byte_starts(text: str, tiled: Sections) -> np.ndarray:
    """First byte of each tile."""
    at = np.array([s for _, s, _ in tiled], np.int64)
    if text.isascii():
        return at
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate(([0], np.cumsum(width)))[at]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    sections: DataFrame | Callable[[str], Sections] = line_sections,
) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing), one row per section.

    ``sections`` is a rule that cuts a text, or a table (doc_id, section, start,
    stop) of character spans, stop exclusive.  Adjacent spans of one name are
    separate rows.  The counts of a document add up to the tokens of the whole
    text.  Null and empty texts have no section and no row; rows without doc_id
    only meet a rule; repeated rows give repeated results; spans with nulls are
    ignored.
    """
    rule = sections if callable(sections) else None
    rows = docs.select("doc_id", "text")
    if rule is None:
        spans = sections.filter("section is not null and start is not null and stop is not null").groupBy(
            F.col("doc_id").alias("__id")
        ).agg(F.collect_set(F.struct(F.col("section").cast("string").alias("section"), F.col("start").cast("bigint").alias("start"),
                                     F.col("stop").cast("bigint").alias("stop"))).alias("spans"))
        rows = rows.join(spans, rows["doc_id"] == spans["__id"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = ByteEncoder(tokenizer, pattern)
        for batch, texts in slices(batches):
            given = batch.column("spans").to_pylist() if rule is None else None
            owner, names, starts, stops, counts, crossed = [], [], [], [], [], []
            for i, text in enumerate(texts):
                if not text:
                    continue
                own = rule(text) if rule else [(s["section"], s["start"], s["stop"]) for s in given[i] or ()]
                tiled = tiles(own, len(text))
                sizes = encoder.sizes_of(text)
                n, crossing = attribute(sizes, _byte_starts(text, tiled), int(sizes.sum()))
                owner += [i] * len(tiled)
                for name, start, stop in tiled:
                    names.append(name)
                    starts.append(start)
                    stops.append(stop)
                counts += n.tolist()
                crossed += crossing.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(names, pa.string()),
                    pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(crossed, pa.int64()),
                ],
                ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, section string, start bigint, stop bigint, n_tokens bigint, n_crossing bigint"
    )
