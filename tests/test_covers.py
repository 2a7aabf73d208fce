"""Cover density against a plain enumeration of stretches."""

import random

import pytest

from lexspark.operators import covers, search
from lexspark.operators.indexing import Analyser, chunk_terms

CHUNK = "chunk_id int, content string, repealed boolean"


def brute(words, asked):
    """Over all stretches: those that hold every term the text has, and hold no smaller such stretch."""
    wanted = {w for w in words if w in asked}
    holds = lambda i, j: wanted <= set(words[i : j + 1])
    score = 0.0
    for i in range(len(words)):
        for j in range(i, len(words)):
            if wanted and holds(i, j) and not (i < j and (holds(i + 1, j) or holds(i, j - 1))):
                score += covers.WEIGHT / (1 + sum(w not in wanted for w in words[i : j + 1]))
    return round(score, 6)


def scores(spark, texts, question, need="all", **options):
    chunks = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], CHUNK)
    asked = search.query_terms(spark.createDataFrame([(1, question)], "qid int, question string"), **options)
    index = covers.positions(chunks, analyser=Analyser(options.get("stop", ()), options.get("lemmas")))
    return {r.chunk_id: r.score for r in covers.cover_scores(index, asked, need).collect()}


def test_against_all_stretches(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    for question in ("a", "a b", "c a e g", "a z"):
        got = scores(spark, texts, question)
        want = {i: brute(t.split(), question.split()) for i, t in enumerate(texts) if set(question.split()) & set(t.split())}
        assert got == pytest.approx(want)


def test_close_beats_far(spark):
    got = scores(spark, ["dog x x x cat", "dog cat", "cat dog x", "dog only"], "dog cat")
    assert got[1] > got[0] and got[1] == got[2] and got[0] == 0.025 and got[3] == 0.1


def test_any_is_the_number_of_occurrences(spark):
    texts = ["a b a c", "b", "c " * 400]
    chunks = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], CHUNK)
    tf = chunk_terms(chunks).where("lexeme in ('a', 'c')").groupBy("chunk_id").sum("tf").collect()
    assert scores(spark, texts, "a c", "any") == pytest.approx({r[0]: 0.1 * r[1] for r in tf})


def test_stop_words_keep_their_places(spark):
    assert scores(spark, ["dog of the cat"], "dog of cat", stop=("of", "the")) == {0: pytest.approx(0.1 / 3, abs=1e-6)}


def test_lemmas_share_a_place(spark):
    lemmas = spark.createDataFrame([("went", "go"), ("went", "wend")], "token string, lemma string")
    assert scores(spark, ["he went home"], "go wend", lemmas=lemmas) == {0: 0.1}


def test_search_and_unknown_need(spark):
    chunks = spark.createDataFrame([(1, "dog cat", False), (2, "dog cat", True), (3, "dog x cat", False), (4, None, False)], CHUNK)
    asked = spark.createDataFrame([(1, "dog cat")], "qid int, question string")
    index = covers.positions(chunks)
    assert [(r.chunk_id, r["rank"]) for r in covers.cover_search(chunks, index, asked).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert covers.cover_search(chunks, index, asked, include_repealed=True).count() == 3
    with pytest.raises(ValueError):
        covers.cover_search(chunks, index, asked, need="some")


def test_positions_of_asked_terms_only(spark):
    chunks = spark.createDataFrame([(1, "a b c a"), (2, "c d")], "chunk_id int, content string")
    asked = spark.createDataFrame([(1, "a"), (1, "d")], "qid int, lexeme string")
    found = covers.positions(chunks, asked=asked)
    assert sorted((r.chunk_id, r.lexeme, r.positions) for r in found.collect()) == [(1, "a", [1, 4]), (2, "d", [2])]
