"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language finds, at each place of a text,
the longest match with that language.  A text is parsed greedily into such
matches; the language that needs the fewest bits (phrases times the log of its
sample size) per character wins.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import top_per_key
from .common import code_points, slices

SAMPLE_TEXTS = 32
SAMPLE_CHARS = 800
SEGMENT = 512
EVIDENCE = 100
_POINTS = 0x110000
_SHIFT = 29  # phrase count above the state in a packed transition


def _letter_table(alphabet: str) -> np.ndarray:
    """Class of every code point: 0 no letter, 1 a letter no sample has, then the letters."""
    table = np.zeros(_POINTS, np.uint8)
    code = {c: i + 2 for i, c in enumerate(alphabet)}
    for point in range(_POINTS):
        c = chr(point)
        if c.isalpha():
            table[point] = code.get(c.lower(), 1)
    return table


def _automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Languages:
    """Packed automata of all languages; a few megabytes per language."""

    names: list[str]
    alphabet: str
    roots: np.ndarray
    table: np.ndarray
    bits: np.ndarray  # per phrase

    def classes(self) -> np.ndarray:
        if not hasattr(self, "_classes"):
            self._classes = _letter_table(self.alphabet)
        return self._classes


def train(samples: dict[str, list[str]]) -> Languages:
    """Automata of the sample texts of each language."""
    names = sorted(samples)
    lowered = {n: [unicodedata.normalize("NFC", t).lower() for t in samples[n]] for n in names}
    alphabet = "".join(sorted({c for ts in lowered.values() for t in ts for c in t if c.isalpha()})[:200])
    code = {c: i + 2 for i, c in enumerate(alphabet)}
    width, between = len(alphabet) + 3, len(alphabet) + 2
    roots, tables, bits, base = [], [], [], 0
    for n in names:
        codes: list[int] = []
        for t in lowered[n]:
            for c in t:
                k = code.get(c, 1) if c.isalpha() else 0
                if k or (codes and codes[-1]):
                    codes.append(k)
            codes.append(between)  # no match runs over two texts
        nxt = _automaton(codes)
        restart = np.full(width, base * width, np.int64)
        restart |= 1 << _SHIFT  # a letter the language lacks is a phrase of its own
        for c, s in nxt[0].items():
            restart[c] = (base + s) * width
        rows = np.tile(restart + (1 << _SHIFT), (len(nxt), 1))  # the match ends, a new one begins
        rows[0] = restart
        for s, edges in enumerate(nxt):
            for c, to in edges.items():
                rows[s, c] = (base + to) * width
        roots.append(base * width)
        tables.append(rows)
        bits.append(np.log2(max(2, len(codes))))
        base += len(nxt)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
    if base * width >= 1 << _SHIFT:
        raise ValueError("too many languages for one table: lower the sample size")
    return Languages(names, alphabet, np.array(roots, np.int64), table.astype(np.int32), np.array(bits))


def phrases(model: Languages, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per text and language, and the parsed characters per text.

    Runs of anything but letters count as one blank.  Long texts are parsed in
    segments of ``SEGMENT`` characters, all in step.
    """
    points, bounds = code_points(texts)
    codes = model.classes()[points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    at = np.concatenate(([0], np.cumsum(keep)))
    codes, bounds = codes[keep].astype(np.int32), at[bounds]
    sizes = np.diff(bounds)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    first = np.cumsum(parts) - parts
    start = bounds[owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
    length = np.minimum(SEGMENT, bounds[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    langs = len(model.names)
    state = np.repeat(model.roots.astype(np.int32)[:, None], len(start), axis=1)
    count = np.zeros((langs, len(start)), np.int32)
    active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
    mask = (1 << _SHIFT) - 1
    for step in range(int(length[0]) if len(length) else 0):
        n = active[step]
        got = model.table[state[:, :n] + codes[start[:n] + step]]
        count[:, :n] += got >> _SHIFT
        state[:, :n] = got & mask
    count += state != model.roots[:, None]
    out = np.zeros((len(texts), langs))
    for k in range(langs):
        out[:, k] = np.bincount(owner, weights=count[k], minlength=len(texts))
    return out, sizes


def predict(model: Languages, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` with score 0 where it has no letter."""
    if not model.names or not texts:
        return ["und"] * len(texts), [0.0] * len(texts)
    found, sizes = phrases(model, texts)
    # neighbouring phrases are not independent: count evidence of EVIDENCE characters at most
    cost = found * model.bits * np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))[:, None]
    best = cost.argmin(axis=1)
    share = 1 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -60)).sum(axis=1)
    letters = np.array([any(c.isalpha() for c in t) for t in texts], bool)
    names = [model.names[b] if ok else "und" for b, ok in zip(best, letters)]
    return names, np.where(letters, share, 0.0).tolist()


def fit(
    docs: DataFrame, usable: Column, *, lang: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS
) -> Languages:
    """Automata from a bounded sample of labelled text.

    Per language ``texts`` documents in hash order, from each ``chars``
    characters at a place the hash gives, so at most texts x chars characters per
    language reach the driver.
    """
    mixed = F.xxhash64("doc_id", "text")
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), mixed.alias("key"),
        F.col("text").substr((F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(chars)).alias("part"),
    )
    samples: dict[str, list[str]] = {}
    for r in top_per_key(rows, ["lang"], ["key", "part"], texts, "rank").orderBy("lang", "rank").collect():
        samples.setdefault(r["lang"], []).append(r["part"])
    return train(samples)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from ``text`` alone.

    Null, empty and letterless texts give ``und`` with score 0; repeated rows give
    repeated results; ties go to the first language in alphabetic order.  Without
    any labelled language all are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches, 2_000_000):
            names, scores = predict(shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
