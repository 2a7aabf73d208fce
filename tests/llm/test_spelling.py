"""Spelling variants against a comparison of all words."""

import random
import zlib

import pytest

from lexspark.llm import catalog, spelling

WORDS = "word string, n long"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    """{word: (n, n_near, form, form_n, root)}."""
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = [n, len(others), form, words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_against_all_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 9, 10, 20, 99, 200, 1000]) for _ in range(500)}
    assert rows(spelling.group_variants(spark.createDataFrame(list(words.items()), WORDS))) == brute(words)


def test_chains_lead_to_the_last_form(spark):
    words = {"a" * k + "b" * (30 - k): 10**k for k in range(12)}
    got = rows(spelling.group_variants(spark.createDataFrame(list(words.items()), WORDS)))
    assert got == brute(words) and {r[4] for r in got.values()} == {"a" * 11 + "b" * 19}


def test_many_words_of_one_root(spark):
    words = {"abcdefgh": 10**6} | {"abcdefgh"[:i] + c + "abcdefgh"[i:]: 5 for i in range(9) for c in "ijklmnopqrstuvwxyzéüñ"}
    assert rows(spelling.group_variants(spark.createDataFrame(list(words.items()), WORDS))) == brute(words)


def test_ties_go_to_the_first_word(spark):
    words = {"zebras": 100, "éebras": 100, "Zebras": 100, "ebras": 1}
    assert rows(spelling.group_variants(spark.createDataFrame(list(words.items()), WORDS)))["ebras"][2] == "Zebras"


def test_empty_and_ratio(spark):
    assert spelling.group_variants(spark.createDataFrame([], WORDS)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("a", 1)], WORDS), ratio=1)


def test_runs_and_cuts(spark):
    docs = spark.createDataFrame([(1, "Ab×c ÉTÉ1x", 0), (2, None, 0), (3, "", 0), (3, "zz" * 30_000, 0)], "doc_id long, text string, run int")
    got = sorted(tuple(r) for r in spelling.runs(docs, "doc_id").collect())
    assert got == [(1, "ab×c"), (1, "x"), (1, "ÉtÉ"), (3, "zz" * 30_000)]
    assert [r.run for r in spelling.runs(docs, "doc_id", least=4).collect() if r.run != "zz" * 30_000] == ["ab×c"]
    cut = spark.createDataFrame([("añb", 0), ("añb", 1), ("añb", 2)], "w string, i long").select(spelling.without("w", spelling.F.col("i")).alias("c"))
    assert [r.c for r in cut.collect()] == ["ñb", "ab", "añ"]


def test_query_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeü") for _ in range(8)) for _ in range(25)]
    texts = [" ".join(rng.choice(stems[: 1 + i % 25]).upper() for _ in range(120)) for i in range(80)] + [None, "", "12 %"]
    docs([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]).write.parquet(f"{tmp_path}/documents.parquet")
    n = {}
    for i, text in [*enumerate(texts), (0, texts[0])]:
        for run in (text or "").split():
            run = run.translate(str.maketrans(spelling._UPPER, spelling._LOWER))
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    assert rows(catalog.op12_spelling_variants(spark, str(tmp_path))) == brute({w: c for w, c in n.items() if c >= 2})
