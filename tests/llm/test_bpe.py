"""BPE against the public encoder, and round trips."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue_pops_by_rank_then_leftmost():
    rng = random.Random(1)
    queue, held = bpe.RankQueue(70_000), []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            entry = rng.choice([rng.randrange(70_000), rng.randrange(5)]), rng.randrange(100)
            queue.push(*entry)
            held.append(entry)
        else:
            held.sort()
            assert queue.pop() == held.pop(0)
    assert [queue.pop() for _ in sorted(held)] == sorted(held) and queue.pop() is None


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 300, "é" * 999, "<|endoftext|> hi", "x\x1c\x1dy\x85z\xa0", "\U0001f600" * 300])
def test_long_and_odd_pieces(codec, public, text):
    assert codec.ids(text) == public.encode_ordinary(text)


def test_every_code_point(codec, public):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for i in range(0, len(every), 20_000):
        spread = " ".join(every[i : i + 20_000 : 7])
        assert codec.ids(spread) == public.encode_ordinary(spread)


def test_latin_texts_take_the_short_classes(codec, public):
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(chr(rng.randrange(256)) for _ in range(200))
        assert codec.ids(text) == public.encode_ordinary(text)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    codec = _CODECS[0]
    ids = codec.ids(text)
    assert ids == _CODECS[1].encode_ordinary(text)
    assert codec.bytes_of(np.array(ids, np.int64)) == text.encode()


_CODECS: list = []


@pytest.fixture(autouse=True)
def _ready(codec, public):
    _CODECS[:] = codec, public


def test_memo_generations(codec, public, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    memo = bpe.Memo(codec.memo.encoder)
    for word in " alpha beta gamma delta alpha beta epsilon alpha".split() * 3:
        assert np.frombuffer(memo[word], "<i4").tolist() == public.encode_ordinary(word)


def test_columns(spark, docs, public):
    long = "naïve words, 漢字 and 😀 " * 5000
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (4, long)]
    df = docs(rows).withColumnRenamed("lang", "token_ids")
    out = bpe.encode(df, PATH, P.PATTERN, decoded="decoded").collect()
    assert len(out) == 5 and set(out[0].asDict()) == {"doc_id", "text", "token_ids", "source", "n_chars", "decoded"}
    for r in out:
        assert r.token_ids == public.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    ids = bpe.encode(df, PATH, P.PATTERN).drop("text")
    assert sorted(bytes(r.decoded) for r in bpe.decode(ids, PATH, P.PATTERN).collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).collect() == []
