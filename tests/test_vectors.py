"""The approximate vector index against the exact leg, and the exact leg's cut."""

import numpy as np
import pytest

from lexspark.operators import search, vectors

CHUNK = "chunk_id long, embedding array<float>, repealed boolean"


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, CHUNK).repartition(parts)


def clustered(n=1500, groups=12, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))).round(3).tolist()


def asked_of(spark, found):
    return spark.createDataFrame([(i, v) for i, v in enumerate(found)], "qid long, vector array<float>")


def ranked(df):
    return sorted((r.qid, r.chunk_id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    chunks = frame(spark, [(i, v, i % 11 == 0) for i, v in enumerate(clustered())])
    vectors.write_vectors(chunks, path, 30)
    return chunks, *vectors.read_vectors(spark, path)


def test_every_row_is_in_the_cell_of_its_nearest_mean(spark, index):
    chunks, rows, means = index
    assert sorted(r.chunk_id for r in rows.collect()) == sorted(r.chunk_id for r in chunks.collect())
    held = sorted(means.collect())
    for r in rows.collect():
        (own,) = vectors.nearest_cells(held, np.array([r.embedding], np.float64), 1)[0]
        assert own == r.cell


def test_recall_and_rows_read(spark, index):
    chunks, rows, means = index
    asked = asked_of(spark, clustered(60, seed=9))
    exact = search.dense_search(chunks, asked, 10)
    found = vectors.approximate_search(rows, means, asked, 6, 10)
    assert search.recall_of(found, exact).first().recall >= 0.9
    seen = vectors.rows_compared(rows, means, asked, 6).first()
    assert seen["all"] == 60 * chunks.where("not repealed").count() and seen.compared < 0.4 * seen["all"]
    right = {(r.qid, r.chunk_id): r.score for r in search.dense_search(chunks, asked, 2000).collect()}
    assert all(right[r.qid, r.chunk_id] == pytest.approx(r.score, abs=1e-6) for r in found.collect())


@pytest.mark.parametrize("most", [1 << 20, 400])
def test_all_cells_are_the_exact_search(spark, index, most):
    chunks, rows, means = index
    asked = asked_of(spark, clustered(20, seed=5) + [[0.0] * 16, [1.0, 2.0]])
    for options in ({}, {"include_repealed": True}):
        want = ranked(search.dense_search(chunks, asked, 7, **options))
        assert ranked(vectors.approximate_search(rows, means, asked, means.count(), 7, most_bytes=most, **options)) == want


def test_odd_vectors(spark, tmp_path):
    rows = [(i, v, False) for i, v in enumerate(clustered(50, 3, 4))] + [(90, [0.0] * 4, False), (91, [1.0], False), (92, None, False), (93, [], False), (94, [1.0, 0.0, 0.0, 0.0], False)]
    chunks = frame(spark, rows)
    vectors.write_vectors(chunks, str(tmp_path), 100)  # more cells than vectors
    held, means = vectors.read_vectors(spark, str(tmp_path))
    assert {r.chunk_id: r.cell for r in held.collect() if r.cell == vectors.NOWHERE} == {90: -1, 91: -1, 93: -1}
    asked = asked_of(spark, [[1.0, 0.0, 0.0, 0.0], [0.0] * 4])
    assert ranked(vectors.approximate_search(held, means, asked, 1000, 100)) == ranked(search.dense_search(chunks, asked, 100))
    with pytest.raises(ValueError):
        vectors.fit(chunks.where("chunk_id = 92"), 3)


def test_one_vector_that_holds_most_rows(spark, tmp_path):
    rows = [(i, [1.0, 0.0, 0.0], False) for i in range(700)] + [(700 + i, v, False) for i, v in enumerate(clustered(300, 5, 3))]
    chunks = frame(spark, rows)
    vectors.write_vectors(chunks, str(tmp_path), 8)
    held, means = vectors.read_vectors(spark, str(tmp_path))
    got = vectors.approximate_search(held, means, asked_of(spark, [[2.0, 0.0, 0.0]]), 1, 25)
    assert [(r.chunk_id, r.score) for r in got.orderBy("rank").collect()] == [(i, 1.0) for i in range(25)]


def test_the_dense_leg_puts_out_no_more_than_its_cut(spark, monkeypatch):
    alike = frame(spark, [(i, [1.0, 1.0], False) for i in range(3000)], 3)
    asked = asked_of(spark, [[1.0, 1.0], [1.0, 0.0], [0.5, 0.5]])
    most = []
    cut = search._top

    def counted(scored, limit):
        most.append(scored.count())
        return cut(scored, limit)

    monkeypatch.setattr(search, "_top", counted)
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 2000)  # less than a batch's scores of one question
    got = search.dense_search(alike, asked, 25)
    assert ranked(got) == [(q, i, 0.707107 if q == 1 else 1.0, i + 1) for q in range(3) for i in range(25)]
    assert most[0] <= 3 * 25 * 3  # questions, cut, batches


def test_what_fitting_sends_to_the_driver_stays_bounded():
    assert [vectors.cells_for(n) for n in (0, 1, 500, 2000)] == [1, 2, 44, 88]
    assert {vectors.cells_for(n) for n in (10_000, 480_000, 1 << 40)} == {vectors.MOST_CELLS}
