"""The pipeline's stages against brute force, each on its own input."""

import random

import public_tokenizers as P
import tiktoken
from test_jaccard import brute as all_pairs
from test_lines import brute as all_lines

import corpus_pipeline as C
from lexspark.llm import bpe, catalog, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("th", "an", "er", "on", "sch", "ung", "lich") for b in ("e", "ing", "en", "at", "ou")]
    out = [(0, None, "en"), (1, "", "en"), (2, "123 456", "en"), (3, "a short one", None)]
    for i in range(40):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(9, 25))) for _ in range(rng.randint(1, 5))]
        out.append((10 + i, "\n".join(lines), rng.choice(["en", "de"]), rng.choice("abc")))
    for i in range(8):
        base = out[10 + i]
        out.append((100 + i, base[1], base[2], "d"))
        out.append((200 + i, base[1].replace(" ", "  ", 1) + " more", base[2], "d"))
    return out


def test_stages(spark, docs, monkeypatch):
    df = docs(rows())
    told = C.language_id(spark, df, "")
    assert told.columns == COLUMNS and {r.doc_id for r in told.collect()} == {r[0] for r in rows()} - {0, 1, 2}
    assert told.where("lang is null").count() == 0

    cut = C.line_dedup(spark, told, "").collect()
    given = sorted((r.doc_id, r.text) for r in told.collect())
    want = all_lines(given, range(len(given)), 2, 8)
    want = {given[i][0]: t for i, t in want.items() if t.split() or t == given[i][1]}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)

    once = C.near_duplicates(spark, df.union(df.where("doc_id = 12")), "")
    groups = all_pairs([(r.doc_id, r.text) for r in df.collect()], 5, 80)
    assert sorted(r.doc_id for r in once.collect()) == sorted(k for k, _, g in groups if k == g) and once.columns == COLUMNS

    mixed = C.source_mix(spark, told, "")
    assert mixed.columns == COLUMNS and mixed.count() > 0
    whole = {r.doc_id: set(r.text.split()) for r in told.collect()}
    assert all(set(r.text.split()) <= whole[r.doc_id] for r in mixed.collect())

    ids = C.token_ids(spark, df, "").collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(catalog.RANKS), special_tokens={})
    text = {r[0]: r[1] or "" for r in rows()}
    assert all(r.round_trip for r in ids)
    assert len(ids) == len(rows()) and all(r.token_ids == enc.encode_ordinary(text[r.doc_id]) for r in ids)


def test_run_and_empty(spark, sf_dir, tmp_path, docs):
    out = C.run(spark, sf_dir)
    assert out.where("not round_trip").count() == 0 < out.count()
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_no_labels_no_rejection_of_letters(spark, docs):
    df = docs([(1, "words", None), (2, "12", None), (3, None, None)])
    assert [r.doc_id for r in C.language_id(spark, df, "").collect()] == [1]


def test_one_of_each_group_where_ids_are_null_or_repeat(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = docs([(1, a), (1, b + " more"), (0, b), (0, b), (None, c), (None, c + " more"), (None, c + " and"), (5, ""), (5, ""), (None, None), (2, a + " x")])
    got = sorted((r.doc_id if r.doc_id is not None else 9, (r.text or "")[:1]) for r in C.near_duplicates(spark, df, "").collect())
    assert got == [(0, "b"), (1, "a"), (5, ""), (9, ""), (9, "c")]


def test_which_row_stays_does_not_depend_on_their_order(spark, docs):
    a = " ".join(f"a{i}" for i in range(30))
    df = docs([(1, a, "en", "x"), (1, a, "en", "w"), (1, a, "de", "z"), (2, a + " b", "en", "v")])
    for d in (df, df.orderBy("source"), df.orderBy("lang").repartition(3)):
        assert [(r.doc_id, r.lang, r.source) for r in C.near_duplicates(spark, d, "").collect()] == [(1, "de", "z")]


def test_source_mix_on_nulls_and_repeats(spark, docs):
    df = docs([(1, "a b c d", "en", None), (1, "a b c d", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (None, "e f", None, "t")])
    got = C.source_mix(spark, df, "")
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} <= {1, None}
    assert all(r.n_chars == len(r.text) and set(r.text.split()) <= set("abcdef") for r in got.collect())
    taken = {r.doc: sum(p.n * p.times for p in r.pieces) for r in mixing.mix(df.dropDuplicates()).collect()}
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: n for k, n in taken.items() if n}
