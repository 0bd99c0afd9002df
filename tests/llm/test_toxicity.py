import random

import numpy as np
from gaugeworks.llm import toxicity as T
from pyspark.sql import functions as F

from .conftest import prose

BAD = ["vexolu", "grompid", "snarbit"]


def corpus(start, n):
    rows, labels = [], []
    for k in range(start, start + n):
        rng = random.Random(k)
        words = prose(k, rng.randint(40, 200)).split()
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "an", "kem", "lu"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark, table, odd_rows):
    rows, labels = corpus(0, 400)
    tests, truth = corpus(1000, 150)
    frame = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = T.fit(table(rows), frame, F.lit(True))
    score = {r.doc_id: r.score for r in T.rate(table(tests), model).collect()}
    right = sum((score[k] >= 0.3) == bool(t) for k, t in truth)
    assert right >= 0.95 * len(truth)
    clean, hidden = model.score(["dil en for gat", "dil en vexoluu for gat"])
    assert hidden > 10 * clean
    odd = T.rate(table(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score < 0.3 for r in odd if r.doc_id in (1, 2, 3))


def test_windows_equal_a_loop():
    texts = ["Ab cde, x", "", "fghijkl 12 a1"]
    codes, _ = T._codes(texts)
    first, stop = T._words(codes)
    weight = np.random.default_rng(0).normal(size=1 << T.BUCKET_BITS)
    bucket_of = {}
    for size, (bucket, valid) in zip(T.SIZES, T._windows(codes)):
        for i in np.flatnonzero(valid):
            bucket_of[tuple(codes[i:i + size].tolist())] = bucket[i]
    want = []
    for a, b in zip(first, stop):
        own = codes[a - 1:b + 1].tolist()
        grams = [tuple(own[i:i + n]) for n in T.SIZES for i in range(len(own) - n + 1)]
        want.append(np.mean([weight[bucket_of[g]] for g in grams]))
    assert [len(x) for x in (first, want)] == [5, 5]
    assert np.allclose(T.word_logits(codes, first, stop, weight, 0.0), want)


def test_one_kind_of_label_or_none(spark, table):
    docs = table([(1, "a b c"), (2, None)])
    for labels, share in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        frame = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        scores = [r.score for r in T.rate(docs, T.fit(docs, frame, F.lit(True))).collect()]
        assert all(abs(s - share) < 0.01 for s in scores)
    assert T.rate(table([]), T.train([], [])).count() == 0
