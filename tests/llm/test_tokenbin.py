"""Token files: exact round trips, and ids against the public library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm import catalog, tokenbin
from lexspark.llm.common import new_folder

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return tokenbin.Words(PATH)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=300))
def test_pack_round_trip(values):
    control, data = tokenbin.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tokenbin.unpack(control, data, len(values)).tolist() == values


def test_pack_of_many_steps():
    values = np.random.default_rng(1).integers(0, 2**20, 5 * tokenbin.STEP + 3)
    assert (tokenbin.unpack(*tokenbin.pack(values), len(values)) == values).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abE'sT é\t\n\x0b\x1c\x85\xa0́　ΣςßÀ×0²ªİ")), max_size=60))
def test_words_as_the_library(words, library, text):
    assert words.known and np.frombuffer(words.packed(text), words.kind).tolist() == library(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab'S don'T 12.5%", "<|endoftext|> <|startoftext|>", "x\x1c\x1dy\x85z\xa0", "\U0001f600" * 300, "É é É́ ΟΔΟΣ", "é" * 700, "!" * 999])
def test_long_and_odd_texts(words, library, text):
    assert np.frombuffer(words.packed(text), words.kind).tolist() == library(text)


def test_latin_texts(words, library):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.randrange(256)) for _ in range(120))
        assert np.frombuffer(words.packed(text), words.kind).tolist() == library(text)


def test_memo_is_bounded(words, library, monkeypatch):
    monkeypatch.setattr(tokenbin, "MEMO", 5)
    text = " ".join(f"word{chr(97 + i)}" for i in range(26))
    assert np.frombuffer(words.packed(text), words.kind).tolist() == library(text) and len(words) <= 5


def test_other_files_go_to_the_library_whole():
    other = tokenbin.Words(P.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert not other.known and np.frombuffer(other.packed("Ab  cd\n é"), other.kind).tolist() == plain.encode("Ab  cd\n é", add_special_tokens=False).ids


def brute(library, texts):
    """(doc, start, n, crc) of rows of (doc, text) in order."""
    out, start = [], 0
    for doc, text in texts:
        ids = [*library(text), 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [1, 50, 1 << 18])
def test_export(spark, library, monkeypatch, block):
    monkeypatch.setattr(tokenbin, "BLOCK_IDS", block)
    rng = random.Random(block)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Größe", "sat!", "x9"]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(7, rows[7][1])] * 3 + [(200, None), (201, ""), (202, "long " * 40_000), (None, "none"), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, ids int, part int").repartition(5)
    back = tokenbin.export(df, PATH, new_folder(spark, "tokens"), end=2)
    got = sorted(((r.doc, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in back.collect()), key=lambda r: r[1])
    assert got == brute(library, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] is None) if r[0] is None else False)))[: len(got)] or (
        # Rows without a key go by the hash of their texts.
        got == brute(library, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] is not None) if r[0] is None else False)))
    )
    assert len(got) == len(rows)


def test_ranks_go_by_frequency(spark, library):
    folder = new_folder(spark, "tokens")
    tokenbin.export(spark.createDataFrame([(1, "the the the cat"), (2, "cat dog")], "doc_id long, text string"), PATH, folder).collect()
    (the,), (cat,), (dog,) = (library(w) for w in ("the", "cat", "dog"))
    found = [(r.rank, r.id, r.n) for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    assert found == [(0, the, 3), (1, cat, 2), (2, dog, 1)]


def test_empty_table(spark):
    back = tokenbin.export(spark.createDataFrame([], "doc_id long, text string"), PATH, new_folder(spark, "tokens"), end=2)
    assert back.count() == 0 and back.columns == ["doc", "start", "n_tokens", "ids"]


def test_query_on_whole_table(spark, sf_dir, library):
    got = sorted(tuple(r) for r in catalog.op11_token_ids(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == brute(library, [tuple(r) for r in docs])
