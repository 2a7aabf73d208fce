"""Fuzzy lookup against the edit distance of all pairs."""

import random

import pytest

from lexspark.operators import trigrams


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_pairs_are_those_of_the_edit_distance(spark, most):
    rng = random.Random(most)
    some = lambda n: "".join(rng.choice("1^aż5") for _ in range(rng.randint(0, n)))
    values, asked = sorted({some(7) for _ in range(250)} | {"", "1", "a"}), sorted({some(7) for _ in range(60)} | {"", "5"})
    index = trigrams.trigram_index(spark.createDataFrame([(v,) for v in [*values, *values[:9], None]], "v string"), "v")
    got = trigrams.fuzzy_pairs(index, spark.createDataFrame([(a,) for a in [*asked, None]], "asked string"), most).collect()
    want = {(a, v) for a in asked for v in values if edits(a, v) <= most}
    assert len(got) == len(want) and {(r.asked, r.value) for r in got} == want


def test_chunks_of_a_batch(spark):
    chunks = spark.createDataFrame([(1, "151^1"), (2, "151"), (3, "94"), (4, "151"), (5, None)], "chunk_id int, article string")
    asked = spark.createDataFrame([(7, "152"), (8, "152"), (9, "9"), (10, None)], "qid int, article string")
    got = {(r.qid, r.chunk_id) for r in trigrams.fuzzy_lookup_batch(chunks, asked).collect()}
    assert got == {(7, 2), (7, 4), (8, 2), (8, 4), (9, 3)}
    assert trigrams.fuzzy_lookup_batch(chunks.limit(0), asked).count() == 0
