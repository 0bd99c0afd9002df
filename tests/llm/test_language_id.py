import math

from gaugeworks.llm import language_id as L
from pyspark.sql import functions as F

from .conftest import prose


def phrases_by_search(text, sample):
    """Greedy parse by substring search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at:at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_a_search():
    sample = "the cat sat on the mat and the dog sat too"
    model = L.train({"en": [sample], "xx": ["zzyyxx wwvv"]})
    for text in ("the cat", "a mat and the rat", "qqq", "zzyy the xx"):
        found, _ = L.phrases(model, [text])
        for k, s in enumerate((sample + "\x00", "zzyyxx wwvv\x00")):
            assert found[0, k] == phrases_by_search(text, s), (text, k)


def test_languages_and_odd_rows(spark, table, odd_rows):
    docs = table([(i, prose(i, 60)) for i in range(100, 140)]).union(
        table([(i, "zwölf Bäume fließen über süße Höhen " * 5) for i in range(200, 240)], "de")
    )
    model = L.fit(docs, F.lit(True))
    assert model.names == ["de", "en"]
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert all(got[i].lang_pred == "en" for i in range(100, 140))
    assert all(got[i].lang_pred == "de" for i in range(200, 240))
    odd = L.identify(table(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    for r in odd:
        assert 0 <= r.score <= 1 and not math.isnan(r.score)
        if r.doc_id in (1, 2, 3, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_empty_table(spark, table):
    docs = table([])
    model = L.fit(docs, F.lit(True))
    assert L.identify(docs, model).count() == 0
    assert [r.lang_pred for r in L.identify(table([(1, "some text")]), model).collect()] == ["und"]


def test_long_texts_are_parsed_whole(spark):
    model = L.train({"en": ["abcabc"]})
    found, sizes = L.phrases(model, ["abc" * 1000])
    assert sizes[0] == 3000 and found[0, 0] >= 3000 / 6
