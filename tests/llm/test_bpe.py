from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
RANKS = bpe.read_ranks()
PUBLIC = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(RANKS), bpe.Decoder(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = list(ENCODER.encode(text))
    assert ids == PUBLIC.encode_ordinary(text) and DECODER.decode(ids) == text


def test_random_bytes_against_merging():
    rng = random.Random(5)
    for _ in range(2000):
        data = bytes(rng.choice([rng.randrange(256), 0x20, 0x65, 0x74]) for _ in range(rng.randint(1, 20)))
        assert ENCODER._transducer.encode(data) == bpe.merge_bytes(data, RANKS)


def test_long_words_and_markers():
    for text in ("ab" * 100_000, "<|endoftext|> x", "=" * 5000, " " * 3000 + "x", "日本" * 4000):
        assert list(ENCODER.encode(text)) == PUBLIC.encode_ordinary(text)


def test_full_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    text = " ".join(f"word{i} überlänge{i * 7}" for i in range(200))
    assert list(bpe.Encoder(RANKS).encode(text)) == PUBLIC.encode_ordinary(text)


def test_decoder_keeps_unfinished_characters():
    ids = PUBLIC.encode_ordinary("🚧é")
    assert "".join(DECODER.stream([*ids, None])) == "🚧é"
    assert DECODER.decode(ids[:1]).startswith("�") or len(ids) == 1


def test_frames(spark):
    df = spark.createDataFrame([(1, "Run tests", "c"), (2, "", "c"), (3, None, "c"), (3, None, "c"), (4, "x" * 50_000, "c")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert got[1] == PUBLIC.encode_ordinary("Run tests") and got[2] == [] and got[3] == [] and got[4] == PUBLIC.encode_ordinary("x" * 50_000)
    assert bpe.encode_corpus(df).count() == 5 and bpe.encode_corpus(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back == {1: "Run tests", 2: "", 3: "", 4: "x" * 50_000}
