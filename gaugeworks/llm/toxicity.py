"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams; their hashed embeddings are averaged
and a linear softmax gives the word's class.  Embeddings and softmax are trained
together.  Only documents are labelled, so training alternates: the words of a
toxic document get credit for its label by how toxic they look next to its worst
word, then the model is fitted to these shares.  A document is as toxic as its worst word, on a scale
fitted to the labelled documents.  A misspelling the labels never had shares most
of its n-grams with the word it hides.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import top_per_key
from ..session import materialised
from .common import code_points, semi_join, slices

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 16
WIDTH = 16
TRAIN_ROWS = 3_000  # per label
TRAIN_CHARS = 6_000  # longer documents are not used for fitting
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 2048, 0.3
SEED = 11

_POINTS = 0x110000
_NUMBER = re.compile("[0-9]+")


def _word_table() -> np.ndarray:
    """Lower-case code point of letters and digits, zero elsewhere."""
    table = np.zeros(_POINTS, np.uint32)
    for point in range(_POINTS):
        c = chr(point)
        if c.isalnum():
            low = c.lower()
            table[point] = ord(low[0]) if low else point
    return table


_TABLE: list[np.ndarray] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word characters of the texts (0 between words) and the bounds of each text."""
    if not _TABLE:
        _TABLE.append(_word_table())
    points, bounds = code_points([f"\n{t}\n" for t in texts])
    return np.concatenate((_TABLE[0][points], np.zeros(max(SIZES), np.uint32))).astype(np.uint64), bounds


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last place of each word; plain numbers are none."""
    inside = np.concatenate(([0], (codes > 0).astype(np.int8), [0]))
    change = np.diff(inside)
    first, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    letters = np.concatenate(([0], np.cumsum((codes > 0) & ((codes < 48) | (codes > 57)))))
    some = letters[stop] > letters[first]
    return first[some], stop[some]


def _windows(codes: np.ndarray):
    """(bucket, valid) of the n-grams that start at each place, per size.

    Word ends count as a character; an n-gram never reaches over one.
    """
    zeros = np.concatenate(([0], np.cumsum(codes == 0)))
    value = codes.copy()
    prime = np.uint64(0x100000001B3)
    done = 1
    for size in SIZES:
        while done < size:
            value = value[:-1] * prime + codes[done:]
            done += 1
        n = len(value)
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        valid = zeros[size - 1: size - 1 + n] == zeros[1: 1 + n]
        yield bucket, valid


def word_logits(codes: np.ndarray, first: np.ndarray, stop: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each word: the mean weight of its n-grams plus the bias."""
    total = np.zeros(len(first))
    count = np.zeros(len(first))
    for bucket, valid in _windows(codes):
        own = np.concatenate(([0.0], np.cumsum(weight[bucket] * valid)))
        number = np.concatenate(([0], np.cumsum(valid)))
        a, b = np.minimum(first - 1, len(bucket)), np.minimum(stop, len(bucket))
        total += own[b] - own[a]
        count += number[b] - number[a]
    return total / np.maximum(count, 1) + bias


@dataclass
class Toxicity:
    """Weight of each bucket (embedding times softmax), and the document scale."""

    weight: np.ndarray
    bias: float
    scale: np.ndarray  # of worst logit, log words, one
    floor: float

    def features(self, texts: list[str]) -> np.ndarray:
        codes, bounds = _codes(texts)
        first, stop = _words(codes)
        logit = word_logits(codes, first, stop, self.weight, self.bias)
        edges = np.searchsorted(first, bounds)
        worst = np.full(len(texts), self.floor)
        some = np.flatnonzero(np.diff(edges))
        if len(some):
            worst[some] = np.maximum.reduceat(logit, edges[:-1][some])
        return np.column_stack((np.clip(worst, -30, 30), np.log1p(np.diff(edges)), np.ones(len(texts))))

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.features(texts) @ self.scale)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in a row, and the bounds of each word."""
    codes, _ = _codes(["\n".join(words)])
    first, stop = _words(codes)
    if len(first) != len(words):
        raise ValueError("every entry must be one word")
    owner, bucket = [], []
    for b, valid in _windows(codes):
        at = np.flatnonzero(valid)
        own = np.searchsorted(first, at + (codes[at] == 0), side="right") - 1
        own[(own >= 0) & (at + (codes[at] == 0) >= stop[own])] = -1
        owner.append(own)
        bucket.append(b[at])
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    keep = owner >= 0
    owner, bucket = owner[keep], bucket[keep]
    at = np.argsort(owner, kind="stable")
    return bucket[at], np.searchsorted(owner[at], np.arange(len(words) + 1))


def _epoch(state: dict, bucket, bounds, positive, negative, order, rate: float) -> None:
    """One pass of weighted softmax regression over the words, embeddings included."""
    e, w, b = state["e"], state["w"], state["b"]
    for k in range(0, len(order), BATCH):
        own = order[k:k + BATCH]
        sizes = bounds[own + 1] - bounds[own]
        own, sizes = own[sizes > 0], sizes[sizes > 0]
        if not len(own):
            continue
        at = np.repeat(bounds[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids = bucket[at]
        starts = np.cumsum(sizes) - sizes
        h = np.add.reduceat(e[ids], starts, axis=0) / sizes[:, None]
        z = h @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        total = positive[own] + negative[own]
        g = p * total[:, None]
        g[:, 1] -= positive[own]
        g[:, 0] -= negative[own]
        gh = (g @ w.T) / sizes[:, None]
        gw, gb = h.T @ g, g.sum(axis=0)
        rows, place = np.unique(ids, return_inverse=True)
        ge = np.column_stack([
            np.bincount(place, weights=np.repeat(gh[:, d], sizes), minlength=len(rows)) for d in range(e.shape[1])
        ])
        state["e2"][rows] += (ge * ge).mean(axis=1)
        e[rows] -= rate * ge / np.sqrt(state["e2"][rows] + 1e-8)[:, None]
        state["w2"] += gw * gw
        w -= rate * gw / np.sqrt(state["w2"] + 1e-8)
        state["b2"] += gb * gb
        b -= rate * gb / np.sqrt(state["b2"] + 1e-8)


def train(texts: list[str], labels: list[int]) -> Toxicity:
    """Fit the model to whole labelled texts."""
    label = np.array(labels, bool)
    if not label.any() or label.all():
        share = float(label.mean()) if len(label) else 0.0
        return Toxicity(np.zeros(1 << BUCKET_BITS), 0.0, np.array([0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))]), 0.0)
    apart = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in texts])  # for the scale
    if not (label[apart].any() and label[~apart].any() and not label[~apart].all()):
        apart[:] = False
    known: dict[str, int] = {}
    doc, word = [], []
    for i, t in enumerate(texts):
        if apart[i]:
            continue
        own = "".join(c if c.isalnum() else " " for c in t.lower())
        for w in sorted({w for w in own.split() if not _NUMBER.fullmatch(w)}):
            doc.append(i)
            word.append(known.setdefault(w, len(known)))
    doc, word, words = np.array(doc), np.array(word), list(known)
    toxic = label[doc]
    n = len(words)
    a, b = np.bincount(word[toxic], minlength=n), np.bincount(word[~toxic], minlength=n)
    # a word of one toxic document and no other tells nothing; of the other rare words a third is enough
    rare = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % 3 > 0 for w in words])
    used = ~((b == 0) & (a < 2)) & ~((a == 0) & (b == 1) & rare)
    bucket, bounds = _bags(words)
    rng = np.random.default_rng(SEED)
    state = {
        "e": rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)), "w": rng.normal(0, 1.0, (WIDTH, 2)), "b": np.zeros(2),
        "e2": np.zeros(1 << BUCKET_BITS), "w2": np.zeros((WIDTH, 2)), "b2": np.zeros(2),
    }
    odds = a * (~label).sum() / max(label.sum(), 1)
    share = np.where(toxic, np.maximum(0, (odds - b) / (odds + b + 3))[word], 0.0)
    for _ in range(ROUNDS):
        positive = np.bincount(word, weights=share, minlength=n)
        negative = np.bincount(word, weights=1 - share, minlength=n)
        for _ in range(EPOCHS):
            _epoch(state, bucket, bounds, positive, negative, rng.permutation(np.flatnonzero(used)), RATE)
        weight = state["e"] @ (state["w"][:, 1] - state["w"][:, 0])
        bias = float(state["b"][1] - state["b"][0])
        sizes = np.maximum(np.diff(bounds), 1)
        total = np.concatenate(([0.0], np.cumsum(weight[bucket])))
        logit = (total[bounds[1:]] - total[bounds[:-1]]) / sizes + bias
        p = _sigmoid(logit)
        # credit for the label, less for words that look milder than the document's worst
        worst = np.zeros(len(texts))
        np.maximum.at(worst, doc, p[word])
        share = np.where(toxic, p[word] * np.sqrt(p[word] / np.maximum(worst[doc], 1e-9)), 0.0)
    model = Toxicity(weight, bias, np.zeros(3), float(logit.min()))
    if not apart.any():
        apart[:] = True
    x = model.features([t for t, own in zip(texts, apart) if own])
    beta, y = np.zeros(3), label[apart].astype(float)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = _sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 1.0 * beta)
    model.scale = beta
    return model


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, *, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS
) -> Toxicity:
    """Fit on at most ``rows`` labelled documents per label, each of ``chars`` characters at most.

    The rows are the first in hash order, so at most 2 x rows x chars characters
    reach the driver.  ``usable`` filters the labels; of several labels of a document
    the toxic one counts.
    """
    toxic = materialised(
        labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic > 0").select(F.col("doc_id").alias("__id"))
    )
    own = labels.filter(usable & F.col("toxic").isNotNull()).select("doc_id")
    key = F.xxhash64("doc_id", "text").alias("key")
    known = semi_join(docs.filter(F.length("text") <= chars).select("doc_id", key), own, "doc_id")
    marked = known.join(toxic, known["doc_id"] == toxic["__id"], "left").select(
        "doc_id", "key", F.col("__id").isNotNull().cast("int").alias("label")
    )
    # ids first, then only the texts of the chosen rows: 2 x rows of them
    chosen = materialised(top_per_key(marked.distinct(), ["label"], ["key", "doc_id"], rows, "rank"))
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "label", "rank"))
    texts = docs.select("doc_id", "text", key)
    got = texts.join(chosen, (texts["doc_id"] == chosen["__id"]) & (texts["key"] == chosen["__key"])).select(
        "label", "rank", "text").distinct().orderBy("label", "rank").collect()
    return train([r["text"] for r in got], [r["label"] for r in got])


def rate(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) of every row from its text alone.

    Null, empty and wordless texts get the score of no word, a low one; repeated
    rows get repeated scores.  Without labels of both kinds all scores are the
    share of toxic labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shared.value.score(texts))], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
