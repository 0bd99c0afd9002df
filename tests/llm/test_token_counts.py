import public_tokenizers
import pytest
from gaugeworks.llm import token_counts as T

from .conftest import prose

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return T.ByteEncoder(PATH, PATTERN)


def brute(text, sections, encoder):
    """Tokens per tile by looking at every byte of every token."""
    tiled = T.tiles(sections, len(text))
    owner = [k for k, (_, a, b) in enumerate(tiled) for c in text[a:b] for _ in c.encode()]
    n, crossing, at = [0] * len(tiled), [0] * len(tiled), 0
    for size in encoder.sizes_of(text):
        own = owner[at:at + size]
        best = max(set(own), key=lambda k: (own.count(k), -k))
        n[best] += 1
        crossing[best] += len(set(own)) > 1
        at += size
    return [(name, a, b, x, y) for (name, a, b), x, y in zip(tiled, n, crossing)]


def test_lines_equal_brute_force(table, odd_rows, encoder):
    rows = odd_rows + [(40, "über\nstraße\n\n日本語\nx"), (41, "no break"), (42, "\n\n\n")]
    got = {}
    for r in T.count_tokens(table(rows), PATH, PATTERN).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.stop, r.n_tokens, r.n_crossing))
    for i, t in rows:
        if t and i not in (None, 5):
            assert sorted(got[i]) == sorted(brute(t, T.line_sections(t), encoder))
            assert sum(x[3] for x in got[i]) == len(encoder.sizes_of(t))
    assert 1 not in got and 2 not in got and len(got[5]) == 2


def test_given_sections(spark, table, encoder):
    text = prose(1, 60)
    spans = [("head", 0, 7), ("mid", 5, 33), ("far", 100, 140), ("tie", 100, 120), ("out", 5000, 6000), ("none", 9, 9)]
    frame = spark.createDataFrame(
        [(1, *s) for s in spans] + [(1, None, 3, 4), (None, "x", 0, 4), (9, "x", 0, 4)],
        "doc_id bigint, section string, start bigint, stop bigint",
    )
    out = T.count_tokens(table([(1, text), (2, "other text"), (None, "a b")]), PATH, PATTERN, frame).collect()
    got = sorted((r.section, r.start, r.stop, r.n_tokens, r.n_crossing) for r in out if r.doc_id == 1)
    assert got == sorted(brute(text, spans, encoder))
    assert [(r.section, r.n_tokens) for r in out if r.doc_id == 2] == [(T.REST, 2)]


def test_tie_goes_to_the_earlier_section(encoder):
    n, crossing = T.attribute(__import__("numpy").array([4]), __import__("numpy").array([0, 2]), 4)
    assert n.tolist() == [1, 0] and crossing.tolist() == [1, 0]


def test_empty_table(table):
    assert T.count_tokens(table([]), PATH, PATTERN).count() == 0
