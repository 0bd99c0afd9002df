import random
import re
from collections import Counter

import pytest
from gaugeworks.llm import collocations as C
from gaugeworks.llm.catalog import LLM_QUERIES, LLM_SQL

SCHEMA = "doc_id bigint, text string, lang string, n bigint, phrase string, rank string"


def reference(rows, least=30, top=2000):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {k: n for k, n in count.items() if n >= least}
    out = []
    for lang in total:
        rows = []
        for (x, w), a in often.items():
            if x != lang or len(w) < 2:
                continue
            cuts = [(2000000 * a // (often[x, w[:k]] + often[x, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            longer = [n for (y, v), n in often.items() if y == lang and len(v) > len(w)
                      and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
            if not any(100 * n >= 80 * a for n in longer):
                rows.append((-score, -a, " ".join(w).encode(), often[x, w[:k]], often[x, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, docs=300):
    """Texts of frequent and rare words, fixed phrases, ends of pieces, repeated lines and odd blanks."""
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(12)] + ["Éa", "ab"]
    fixed = ["the long way round the old town hall again", "a b c", "x y", "no no no no no", "Über Den"]
    out = []
    for k in range(docs):
        parts = []
        for _ in range(rng.randint(1, 30)):
            r = rng.random()
            parts.append(rng.choice(fixed) if r < 0.2 else f"rare{rng.randint(0, 3000)}" if r < 0.3 else rng.choice(common))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ", "? "]))
        out.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", None), ("one", "fr"), ("x y " * 400, "de")]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(k, t, lang, 1, "p", "r") for k, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, C.collocations(frame, **options).collect()))


def test_against_counting(spark):
    rows = corpus(1)
    want = reference(rows)
    assert len(want) > 30 and {r[0] for r in want} >= {"en", "de", "und"}
    assert run(spark, rows) == want


@pytest.mark.parametrize("share", [1024, 30, 1])
def test_small_bit_table_and_hot_words_change_nothing(spark, monkeypatch, share):
    monkeypatch.setattr(C, "BITS", 1 << 15)
    monkeypatch.setattr(C, "HOT_SHARE", share)
    monkeypatch.setattr(C, "SALTS", 5)
    rows = corpus(2, 80)
    assert run(spark, rows, least=5, top=40) == reference(rows, 5, 40)


def test_paths_hold_long_phrases(spark):
    rows = [("Start of the very same line here. ", "en")] * 40 + [("of the very other", "en")] * 35
    frame = spark.createDataFrame([(k, t, lang, 1, "p", "r") for k, (t, lang) in enumerate(rows)], SCHEMA)
    counts, _ = C.phrase_counts(frame)
    whole = {(r.phrase, r.n) for r in C.paths(counts).collect()}
    assert whole == {("start of the very", 40), ("of the very same line here", 40), ("of the very other", 35)}
    assert run(spark, rows) == reference(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en"), (" . \n", "de")], [("only a few words", "en")]])
def test_nothing_to_count(spark, rows):
    assert run(spark, rows) == []


def test_query_and_sql(spark, tmp_path):
    rows = corpus(3)
    frame = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = LLM_QUERIES["op12_collocations"](spark, str(tmp_path))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = reference(rows)
    assert sorted(map(tuple, found.collect())) == want
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(LLM_SQL["op12_collocations"]).fetchall()) == want
