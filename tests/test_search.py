"""Ranking and fusion: what a rare term, length, repeals and two legs do to results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import evaluation, indexing, search

CHUNK = "chunk_id int, act string, article string, content string, repealed boolean"


def index(spark, rows):
    chunks = spark.createDataFrame(rows, CHUNK)
    terms = indexing.chunk_terms(chunks).persist()
    return chunks, terms, indexing.corpus_stats(chunks, terms)


def ask(spark, rows, question, **options):
    asked = spark.createDataFrame([(1, question)], "qid int, question string")
    found = search.lexical_search(*index(spark, rows), asked, **options)
    return [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def corpus():
    rows = [(1, "a", "1", "common " * 30, False)]
    rows += [(i, "a", str(i), f"common filler{i} words here", False) for i in range(2, 11)]
    return [*rows, (11, "a", "11", "common rare", False)]


def test_rare_beats_repeated_common_under_bm25_only(spark, corpus):
    assert ask(spark, corpus, "common rare")[0][0] == 11
    assert ask(spark, corpus, "common rare", ranking="tf")[0][0] == 1


def test_shorter_wins_and_b_zero_ties(spark):
    rows = [(1, "a", "1", "rare one", False), (2, "a", "2", "rare " + "filler " * 200, False), (3, "a", "3", "other", False)]
    assert [c for c, _ in ask(spark, rows, "rare")] == [1, 2]
    tied = ask(spark, rows, "rare", b=0.0)
    assert tied[0][1] == tied[1][1] and [c for c, _ in tied] == [1, 2]


def test_scores_are_not_negative_and_stop_words_find_nothing(spark, corpus):
    assert all(s >= 0 for _, s in ask(spark, corpus, "common"))
    assert ask(spark, corpus, "common", stop=("common",)) == []
    assert ask(spark, corpus, "!?") == []


def test_repealed_are_out_but_count(spark):
    rows = [(1, "a", "1", "rare x", False), (2, "a", "2", "rare y", True), (3, "a", "3", "z", False)]
    assert [c for c, _ in ask(spark, rows, "rare")] == [1]
    with_all = dict(ask(spark, rows, "rare", include_repealed=True))
    assert set(with_all) == {1, 2} and ask(spark, rows, "rare")[0][1] == with_all[1]


def test_lemmas_multiply_and_fall_through(spark):
    chunks = spark.createDataFrame([(1, "a", "1", "went home", False)], CHUNK)
    lemmas = spark.createDataFrame([("went", "go"), ("went", "wend")], "token string, lemma string")
    found = {r.lexeme: r.doc_len for r in indexing.chunk_terms(chunks, lemmas=lemmas).collect()}
    assert found == {"go": 3, "wend": 3, "home": 3}


def test_staleness(spark, corpus):
    chunks, terms, stats = index(spark, corpus)
    assert not indexing.staleness(stats, chunks, terms).first().stale
    assert indexing.staleness(stats, chunks.where("chunk_id > 1"), terms).first().stale


def test_index_round_trip(spark, corpus, tmp_path):
    chunks, terms, stats = index(spark, corpus)
    indexing.write_index(chunks, str(tmp_path), "v1")
    back, back_stats = indexing.read_index(spark, str(tmp_path), "v1")
    assert back.exceptAll(terms).count() == 0 and back_stats.collect() == stats.collect()


def leg(spark, rows):
    return spark.createDataFrame([(1, c, s, r) for c, s, r in rows], "qid int, chunk_id int, score double, rank int")


def merged(spark, lex, den, **options):
    return [(r.chunk_id, r.score, r.lexical_rank, r.dense_rank) for r in search.merge(leg(spark, lex), leg(spark, den), **options).orderBy("rank").collect()]


def test_agreement_outranks_a_single_leg(spark):
    out = merged(spark, [(1, 9.0, 1), (2, 8.0, 2)], [(2, 0.9, 1), (3, 0.8, 2)], fusion="rrf", alpha=0.5)
    assert out[0][0] == 2 and out[0][2:] == (2, 1)
    assert out[1][2:] in ((1, None), (None, 2))


def test_rrf_at_one_half_is_the_classic(spark):
    out = merged(spark, [(1, 9.0, 1), (2, 8.0, 2)], [(3, 0.9, 1)], fusion="rrf", alpha=0.5)
    assert [c for c, *_ in out] == [1, 3, 2]
    assert out[0][1] == round(0.5 / 61, 6)


def test_weighted_flat_leg_and_empty_leg(spark):
    out = dict((c, s) for c, s, *_ in merged(spark, [(1, 5.0, 1), (2, 5.0, 2)], [(1, 0.9, 1), (3, 0.1, 2)], alpha=0.8))
    assert out == {1: 1.0, 2: 0.2, 3: 0.0}
    assert [c for c, *_ in merged(spark, [], [(1, 0.9, 1), (3, 0.1, 2)])] == [1, 3]


def test_weighted_demotes_what_rrf_lifts(spark):
    lex, den = [(1, 10.0, 1), (2, 9.9, 2)], [(2, 0.01, 2), (3, 0.9, 1)]
    assert merged(spark, lex, den, fusion="rrf", alpha=0.5)[0][0] == 2
    assert merged(spark, lex, den, alpha=0.8)[0][0] == 3


def test_truncation_and_unknown_options(spark):
    assert len(merged(spark, [(i, 1.0 / i, i) for i in range(1, 9)], [], k=3)) == 3
    with pytest.raises(ValueError):
        merged(spark, [], [], fusion="sum")


def test_dense_excludes_missing_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], False), (2, None, False), (3, [0.0, 1.0], False), (4, [1.0, 0.1], True)], "chunk_id int, embedding array<float>, repealed boolean")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<float>")
    assert [(r.chunk_id, r.score) for r in search.dense_search(rows, asked).orderBy("rank").collect()] == [(1, 1.0), (3, 0.0)]


def test_scores_and_misses(spark):
    truth = spark.createDataFrame([(1, "a", "1"), (1, "a", "2"), (2, "a", "9"), (3, "a", "5")], "qid int, act string, article string")
    got = [(1, "a", "1", 1), (1, "a", "2", 7), (2, "b", "9", 1), (3, "a", "4", 1), (3, "a", "5", 2)]
    per = evaluation.per_question(truth, spark.createDataFrame(got, "qid int, act string, article string, rank int"))
    s = evaluation.scores(per).first()
    assert (s.n_questions, s.recall_at_5, s.recall_at_10, s.hit_rate_5) == (3, 0.5, 0.666667, 0.666667)
    assert s.mrr == 0.5 and [r.qid for r in evaluation.missed(per).collect()] == [2]


def gate(spark, rows, **options):
    values = spark.createDataFrame(rows, "run_seq int, layer string, metric string, value double")
    return {(r.layer, r.metric): r for r in evaluation.gate(values, **options).collect()}


def test_gate_tolerance_layers_and_floors(spark):
    ok = gate(spark, [(1, "retrieval", "r", 0.88), (2, "retrieval", "r", 0.85)])
    assert ok["retrieval", "r"].passed
    bad = gate(spark, [(1, "retrieval", "r", 0.88), (2, "audit", "f1", 0.1), (3, "retrieval", "r", 0.8499), (3, "retrieval", "new", 0.1)])
    assert not bad["retrieval", "r"].passed and bad["retrieval", "new"].passed and bad["audit", "f1"].passed
    floor = gate(spark, [(1, "audit", "f1", 0.4)], floors={"f1": 0.5})
    assert floor["audit", "f1"].below_floor and not floor["audit", "f1"].passed
    assert gate(spark, []) == {}


def test_unpriced_model_costs_the_most(spark):
    calls = spark.createDataFrame([("cheap", 1_000_000, 0), ("other", 1_000_000, 1_000_000)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("cheap", 1.0, 5.0), ("strong", 3.0, 15.0)], "model string, rate_in double, rate_out double")
    assert {r.model: r.cost_usd for r in evaluation.usage(calls, prices).collect()} == {"cheap": 1.0, "other": 18.0}


def test_config_hash_is_stable():
    assert evaluation.config_hash({"a": 1, "b": 2}) == evaluation.config_hash({"b": 2, "a": 1})
    assert len(evaluation.config_hash({"a": 1})) == 12 != evaluation.config_hash({"a": 2})


def test_latest(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (3, "a", 3.0), (2, "b", 2.0)], "run_seq int, layer string, value double")
    assert {r.layer: r.value for r in evaluation.latest_for_layer(rows).collect()} == {"a": 3.0, "b": 2.0}
    assert evaluation.latest_for_layer(rows.where(F.lit(False))).count() == 0


def test_dense_blocks_equal_plain_cosines(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(300)] + [[0.0] * 6, [1.0, 2.0], None]
    chunks = spark.createDataFrame([(i, v, i % 7 == 0) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>, repealed boolean").repartition(5)
    asked = [(q, rng.integers(-2, 3, 6).astype(float).tolist()) for q in range(9)]
    want = set()
    for q, v in asked:
        scores = []
        for i, e in enumerate(vectors):
            if e is None or i % 7 == 0:
                continue
            norm = np.linalg.norm(e) * np.linalg.norm(v) if len(e) == 6 else 0
            scores.append((-round(float(np.dot(e, v) / norm), 6) if norm else 9, i))
        want |= {(q, i, None if s == 9 else -s, n) for n, (s, i) in enumerate(sorted(scores)[:25], 1)}
    frame = spark.createDataFrame(asked, "qid long, vector array<float>")
    for most in (1 << 20, 300):
        got = {(r.qid, r.chunk_id, None if r.score is None else round(r.score, 6), r["rank"]) for r in search.dense_search(chunks, frame, 25, most_bytes=most).collect()}
        assert got == want


def test_stored_frequencies_give_the_same_scores(spark, corpus, tmp_path):
    chunks, terms, stats = index(spark, corpus)
    indexing.write_index(chunks, str(tmp_path), "v1")
    held = indexing.read_frequencies(spark, str(tmp_path), "v1")
    assert {r.lexeme: r.df for r in held.collect()} == {r.lexeme: r["count"] for r in terms.groupBy("lexeme").count().collect()}
    asked = spark.createDataFrame([(1, "common rare"), (2, "words nowhere")], "qid int, question string")
    plain = search.lexical_search(chunks, terms, stats, asked)
    assert sorted(map(tuple, search.lexical_search(chunks, terms, stats, asked, frequencies=held).collect())) == sorted(map(tuple, plain.collect()))


def test_postings_by_chunk_rank_like_rows_and_shuffle_none(spark, corpus, tmp_path):
    rows = [*corpus, (12, "a", "12", "common rare", True), (13, "a", "13", "rare again", False), (14, "a", "14", None, False)]
    chunks, terms, stats = index(spark, rows)
    indexing.write_index(chunks, str(tmp_path), "v1")
    held = indexing.read_postings(spark, str(tmp_path), "v1")
    asked = spark.createDataFrame([(1, "common rare"), (2, "words nowhere"), (3, "rare")], "qid int, question string")
    for options in ({}, {"ranking": "tf"}, {"include_repealed": True}, {"limit": 2}):
        got, want = (search.lexical_search(chunks, i, stats, asked, **options) for i in (held, terms))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    scored = search._scored(held, asked.select("qid", F.explode(F.split("question", " ")).alias("lexeme"), F.lit(1.0).alias("weight")), 2, lambda tf, _: tf)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.groupBy("qid").count().agg(F.max("count")).first()[0] <= 2 * scored.rdd.getNumPartitions()


def test_rows_of_one_chunk_are_counted_together(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "chunk_id int, content string")
    indexing.write_index(chunks, str(tmp_path), "v1")
    back = indexing.read_index(spark, str(tmp_path), "v1")[0]
    assert sorted(map(str, back.collect())) == sorted(map(str, indexing.chunk_terms(chunks).collect()))


def test_several_rankings_read_the_index_once(spark, corpus, tmp_path):
    chunks, _, stats = index(spark, corpus)
    indexing.write_index(chunks.select("chunk_id", "content"), str(tmp_path), "v1")
    held = indexing.read_postings(spark, str(tmp_path), "v1")
    asked = spark.createDataFrame([(0, "common rare"), (1, "filler4 words"), (2, "nothing")], "qid int, question string")
    how = [{}, {"b": 0.0}, {"ranking": "tf"}, {"k1": 0.4}]
    got = search.lexical_rankings(chunks, held, stats, asked, how, 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [(i, *r) for i, options in enumerate(how) for r in search.lexical_search(chunks, held, stats, asked, 3, **options).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
