import math
from collections import Counter, defaultdict

import numpy as np
from gaugeworks.llm import quality as Q

from .conftest import prose


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters, from its definition."""
    pad = "\x01" * 4
    grams = {n: Counter() for n in range(1, 6)}
    for t in texts:
        t = " ".join(t.split())
        s = pad + t
        for i in range(4, len(s)):
            grams[5][s[i - 4:i + 1]] += 1
    for n in (4, 3, 2, 1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cuts = {n: Q.discounts([sum(c == k for c in grams[n].values()) for k in range(1, 5)]) for n in grams}
    total, taken = defaultdict(int), defaultdict(float)
    for n in grams:
        for g, c in grams[n].items():
            total[n, g[:-1]] += c
            taken[n, g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(h, w):
        n = len(h) + 1
        lower = p(h[1:], w) if h else 1 / 4096
        if not total[n, h]:
            return lower
        c = grams[n][h + w]
        return (c - cuts[n][min(c, 3) - 1] if c else 0) / total[n, h] + taken[n, h] / total[n, h] * lower

    def score(t):
        s = pad + " ".join(t.split())
        return sum(math.log(p(s[i - 4:i], s[i])) for i in range(4, len(s)))

    return score


def test_scores_equal_the_definition(spark, table, monkeypatch):
    trusted = [(k, prose(k, 50)) for k in range(30)]
    asked = [(100, prose(100, 40)), (101, "Zebra ZEBRA!! 123"), (102, ""), (103, None), (104, prose(3, 50))]
    want = brute_model([t for _, t in trusted])
    for entries in (Q.CHUNK_ENTRIES, 3_000):  # one chunk of the model, and many
        monkeypatch.setattr(Q, "CHUNK_ENTRIES", entries)
        model = Q.train(table(trusted))
        assert (len(list(model.chunks())) > 1) == (entries == 3_000)
        for r in Q.score(table(asked), model).collect():
            text = " ".join((r.text or "").split())
            assert r["__size"] == len(text)
            assert abs((r["__logp"] or 0) - want(text)) < 1e-3 * max(1, len(text)), r.doc_id


def test_places_are_indices():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**60, 50_000)
    distinct = np.unique(key)
    assert (distinct[Q._places(distinct, key)] == key).all()


def test_junk_goes_and_clean_text_stays(spark, table, odd_rows):
    clean = [(k, prose(k, 60)) for k in range(400)]
    junk = [(1000 + k, " ".join(f"{w.upper()}!!" for w in prose(k, 60).split())) for k in range(40)]
    docs = table(clean + junk)
    trusted = spark.createDataFrame([(k,) for k in range(300)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r.accepted for r in Q.classify(docs, trusted).collect()}
    assert sum(got[k] for k in range(400)) >= 390
    assert not any(got[1000 + k] for k in range(40))
    odd = Q.classify(table(odd_rows), trusted)
    assert odd.columns[:8] == docs.columns and odd.count() == len(odd_rows)


def test_without_trusted_text_all_are_accepted(spark, table, odd_rows):
    nobody = spark.createDataFrame([], "doc_id bigint")
    rows = Q.classify(table(odd_rows, None), nobody).collect()
    assert len(rows) == len(odd_rows) and all(r.accepted and r.perplexity is None for r in rows)
    assert Q.classify(table([]), nobody).count() == 0
