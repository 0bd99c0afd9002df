import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, fp string, length string"
SYLLABLES = ["an", "ber", "cho", "dil", "en", "for", "gat", "he", "ing", "jor", "kem", "lu"]


def prose(seed: int, words: int) -> str:
    """Invented sentences, the same for each seed."""
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        n = rng.randint(6, 14)
        out += ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
        out[-1] += "."
    return " ".join(out[:words])


@pytest.fixture(scope="session")
def table(spark):
    """DataFrame of documents from (doc_id, text) with names that operators also use."""

    def make(rows, lang="en"):
        full = [(i, t, lang, f"s{(i or 0) % 3}", len(t or ""), "k", "f", "l") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, odd characters, one very long text."""
    long = prose(99, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (None, prose(1, 80)),
        (None, None), (6, prose(1, 80)), (7, "日本語 テキスト ₤ <|endoftext|> İ ſ"), (8, long), (9, "x" * 50_000),
        (10, "!!! ??? 123"), (11, "a\u0000b\u001fc"), (12, prose(2, 120)),
    ]
