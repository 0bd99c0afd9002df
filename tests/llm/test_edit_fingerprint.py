import hashlib

import numpy as np
from gaugeworks.llm import edit_fingerprint as E

from .conftest import prose


def slow_embed(text):
    """The walk of one text, step by step."""
    moves, votes, signs = E._tables()
    if 0 < len(text) <= E.SEGMENT // 2:
        text = text * (E.SEGMENT // len(text))
    total = np.zeros(E.BITS, np.int64)
    for k in range(0, len(text), E.SEGMENT):
        codes = []
        for c in text[k:k + E.SEGMENT]:
            p = ord(c)
            codes.append(1 + (p ^ p >> 8 ^ p >> 16) % (E.CLASSES - 1))
        codes.append(0)
        at, own = 0, np.zeros(E.BITS, np.int64)
        for step in range(E.STEPS):
            own[step % E.BITS] += votes[step][codes[at]]
            at += int(moves[step][codes[at]])
        total += own * signs[k // E.SEGMENT % len(signs)]
    return np.packbits(total > 0).tobytes()


def test_embedding_equals_the_walk():
    texts = [prose(1, 30), "", "a", prose(2, 400), "日本語" * 300, "x" * 512, "y" * 257]
    assert [b.tobytes() for b in E.embed(texts)] == [slow_embed(t) for t in texts]


def test_edits_change_little():
    text = prose(5, 400)
    words = text.split()
    words[50] = "other"
    bits = E.embed([text, " ".join(words), "Xx " + text, prose(6, 400)])
    near = E.likeness(np.repeat(bits[:1], 3, axis=0), bits[1:])
    assert near[0] > 0.8 and near[1] > 0.55 and near[2] < 0.4


def expected(rows):
    """Results from a sort on the driver; texts tell rows of one id apart."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id bigint, text string")
    ordered = [r.text for r in frame.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h").collect()]
    ids = [r.doc_id for r in frame.selectExpr("doc_id", "xxhash64(text) h").orderBy("doc_id", "h").collect()]
    out = []
    for k, (i, t) in enumerate(zip(ids, ordered)):
        other = ordered[(k + 1) % len(ordered)]
        new = E.edited(t, other)
        bits = E.embed([t, new, other])
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), bits[0].tobytes().hex(), bits[1].tobytes().hex(),
                    float(E.likeness(bits[:1], bits[1:2])[0]), float(E.likeness(bits[:1], bits[2:])[0])))
    return sorted(out, key=str)


def test_order_and_odd_rows(table, odd_rows):
    rows = odd_rows + [(k, prose(k, 20 + k % 30)) for k in range(100, 200)]
    docs = table(rows).repartition(7)
    for chars in (8_000_000, 2_000):
        got = sorted(map(tuple, E.fingerprint(docs, part_chars=chars).collect()), key=str)
        assert got == expected(rows)


def test_single_and_empty(table):
    row, = E.fingerprint(table([(3, "abcdefgh")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert E.fingerprint(table([])).count() == 0


def test_banded_links(spark):
    text = prose(9, 300)
    words = text.split()
    texts = [text]
    for k in range(5):
        texts.append(" ".join(words[: 40 * k + 10] + ["new"] + words[40 * k + 11:]))
    texts += [prose(k, 300) for k in range(20, 40)]
    prints = [b.tobytes().hex() for b in E.embed(texts)]
    frame = spark.createDataFrame([(p,) for p in prints] + [(None,), (prints[0],)], "fingerprint string")
    links = [(r.a, r.b) for r in E.banded_links(frame, least=0.5).collect()]
    reach, grown = {prints[0]}, True
    while grown:
        more = {x for a, b in links for x in (a, b) if a in reach or b in reach} | reach
        grown, reach = more != reach, more
    assert reach == set(prints[:6])
    assert E.banded_links(frame.limit(0)).count() == 0
