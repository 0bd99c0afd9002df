import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from gaugeworks.llm import arrow_tokens as A
from tokenizers import Tokenizer

from .conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer, odd_rows, monkeypatch):
    texts = [t or "" for _, t in odd_rows] + [
        "DON'T we'Re it's 'S", "Straße ÀÉ 12½³ a_b __ $$$ x²y", "İstanbul Σίσυφος ΟΔΟΣ", "\x1c a\x1fb\x85c\xa0d",
        "é ÿ µ ª º", "× ÷ ¼¾ ²", "<|startoftext|>x", "é ﬁ",
    ]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in A.WordEncoder(PATH).encode(texts)] == want
    monkeypatch.setattr(A, "CACHE_WORDS", 5)  # the cache is emptied again and again
    encoder = A.WordEncoder(PATH)
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_every_latin_character(tokenizer):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(256)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in A.WordEncoder(PATH).encode(texts)] == want


def test_round_trip(spark, table, odd_rows, tokenizer):
    rows = odd_rows + [(k, prose(k, 40)) for k in range(100, 160)]
    place = A.token_folder(spark)
    manifest = A.write_tokens(table(rows).repartition(5), place, PATH, length=64, rows=4)
    got = A.read_tokens(manifest, place).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    by_text = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    want = sorted(((i, len(by_text[t]), zlib.crc32(np.array(by_text[t], "<u4").tobytes())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for f in manifest.collect():
        fs, _ = A._filesystem(place)
        batches = list(pa.ipc.open_stream(fs.open_input_file(f.token_path)))
        assert all(b.num_rows == 4 for b in batches[:-1])
        assert batches[0].schema.field("tokens").type == pa.list_(pa.uint16(), 64)
        mask = np.concatenate([b.column("mask").values.to_numpy(zero_copy_only=False) for b in batches])
        assert mask.sum() == f.tokens and (np.diff(mask.astype(int)) <= 0).all()


def test_empty_table(spark, table):
    place = A.token_folder(spark)
    assert A.read_tokens(A.write_tokens(table([]), place, PATH), place).count() == 0


def test_lengths(table, odd_rows, tokenizer):
    got = A.token_lengths(table(odd_rows), PATH).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.length == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
