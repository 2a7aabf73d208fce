"""N-gram Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from lexspark.llm import jaccard as J


def brute(rows, k, percent):
    sets, of = [], []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    of = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            old, new = of[b], of[a]
            of = [new if x == old else x for x in of]
    low = {}
    for (key, _), g in zip(rows, of, strict=True):
        low[g] = key if low.get(g) is None else low[g] if key is None else min(low[g], key)
    return sorted(((key, len(s), low[g]) for (key, _), s, g in zip(rows, sets, of, strict=True)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "A"), (4, "a"), (5, "One two"), (6, "one\ttwo"), (6, "one\ttwo"), (None, "one two")]
    for i in range(14):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                words[rng.randrange(len(words))] = rng.choice("xyz") * rng.randint(1, 4)
            rows.append((100 + len(rows), " ".join(words)))
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(20_000))
    return [*rows, (900, long), (901, long + " end")]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 55)])
def test_groups_equal_all_pairs(spark, k, percent):
    rows = corpus(k)
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in J.near_duplicates(df, k=k, percent=percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in J.near_duplicates(df, k=3, percent=90).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(df).collect() == []


def test_sketch_distance_is_a_lower_bound_and_parts_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = int(rng.integers(0, 1 + len(a) // 8))
        b = np.unique(np.r_[a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(J.sketch(a, 4) ^ J.sketch(b, 4)).sum() <= apart
        for percent in (80, 90):
            if J._linked(a, b, percent):
                assert len(np.intersect1d(J.part_keys(a, percent), J.part_keys(b, percent))) or np.array_equal(a, b)
