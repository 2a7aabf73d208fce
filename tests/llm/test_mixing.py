"""The mix: targets, draws, permutations, and what is taken of each document."""

import random

import numpy as np
import pytest

from lexspark.llm import mixing as M


def test_targets_stop_at_the_cap_and_share_the_rest():
    assert M.targets([10, 100, 1000], [5, 2, 1]) == pytest.approx([30, 300, 780])
    assert M.targets([0, 50], [5, 2]) == pytest.approx([0, 50])
    assert M.targets([], []) == [] and M.targets([0], [1]) == [0]
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1000) for _ in range(rng.randint(1, 12))]
        t = M.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes, strict=True))


def test_draws_are_exact_in_sum_and_repeat():
    counts = M.draw([500, 40, 0, 7], 16, 3)
    assert counts.sum(0).tolist() == [500, 40, 0, 7] and (counts >= 0).all()
    assert (counts == M.draw([500, 40, 0, 7], 16, 3)).all() and (counts != M.draw([500, 40, 0, 7], 16, 4)).any()
    assert {int(x) for x in counts.sum(1)} <= {547 // 16, 547 // 16 + 1}
    assert M.draw([], 4, 1).sum() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    out = M.permuted(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 50 or (out != np.arange(n)).any()


def rows(rng):
    out = [(1, None, "en", "b"), (2, "", "en", None), (3, " \n ", "en", "a"), (None, "null key here", "en", "a"), (3, "same same", "en", "a"), (3, "same same", "en", "a")]
    for i in range(400):
        n = rng.choice([1, 5, 30, 200, 2000])
        out.append((10 + i, " ".join(f"w{j}" for j in range(n)), "en", rng.choice(["a", "a", "a", "b", "c", None])))
    return out


def test_taken_words_meet_targets(spark, docs):
    df = docs(rows(random.Random(2))).withColumnRenamed("lang", "pieces")
    out = M.mix(df, block_words=16, shards=32).collect()
    again = M.mix(df.repartition(7), block_words=16, shards=32).collect()
    key = lambda r: (str(r.doc), str(r.at), str(r.source), str(r.pieces))
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == 406
    by = {}
    for r in out:
        taken = sum(p.n * p.times for p in r.pieces)
        assert taken <= 3 * r["size"] and all(p["first"] + p.n <= r["size"] for p in r.pieces)
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0], s[1] = s[0] + taken, s[1] + r["size"]
    assert sum(s[2] for s in by.values()) == pytest.approx(sum(s[3] for s in by.values()))
    for taken, size, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= max(64, 0.02 * target)


def test_empty_table_and_wordless_sources(spark, docs):
    assert M.mix(docs([])).collect() == []
    (r,) = M.mix(docs([(1, "")])).collect()
    assert (r["size"], r.target, r.pieces) == (0, 0.0, [])


def test_documents_of_the_mix(spark, docs):
    text = " ".join(f"w{j}" for j in range(500)) + "\n"
    df = docs([(1, text, "en", "a"), (2, text, "en", "b"), (3, None, "en", "b"), (4, "x y", "en", "c"), (4, "x y", "en", "c")])
    out = M.mixed_documents(df, block_words=16, shards=4)
    taken = {r.doc: sum(p.n * p.times for p in r.pieces) for r in M.mix(df.dropDuplicates(), block_words=16, shards=4).collect()}
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def test_cut():
    text = " a b\nc  d e "
    assert M.cut(text, [(0, 5)]) == text and M.cut(text, [(0, 2), (2, 3)]) == text
    assert M.cut(text, [(1, 2)]) == "b\nc" and M.cut(text, [(0, 1), (3, 2)]) == "a\nd e"


@pytest.mark.parametrize("chunks", [1000, 2])
def test_taken_words_equal_a_plain_count_of_blocks(spark, docs, monkeypatch, chunks):
    monkeypatch.setattr(M, "CHUNKS", chunks)
    given = rows(random.Random(9))[:120]
    df = docs(given)
    out = M.mix(df, block_words=16, shards=8, seed=3).collect()
    names = sorted({r[3] for r in given}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((r[1] or "").split()) for r in given if r[3] == s) for s in names]
    want = M.targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    bucket = {(r.doc, r.at): r.b for r in spark.createDataFrame([(r.doc, r.at) for r in out], "doc long, at long").selectExpr("doc", "at", f"pmod(xxhash64(doc, at), {M.BUCKETS}) b").collect()}
    for number, (name, size, target) in enumerate(zip(names, sizes, want, strict=True)):
        blocks = -(-size // 16)
        uses = [0] * blocks
        for slot in range(min(round(target * blocks / size), 3 * blocks) if size else 0):
            turn, index = divmod(slot, blocks)
            uses[M.permuted(np.array([index]), blocks, 3 * 1_000_003 + number * 1009 + turn)[0]] += 1
        mine = sorted((r for r in out if r.source == name), key=lambda r: (bucket[r.doc, r.at], r.doc is not None, r.doc or 0, r.at, r["size"]))
        place = 0
        for r in mine:
            assert r.target == pytest.approx(target) and r.source_size == size
            words = [uses[(place + i) // 16] for i in range(r["size"])]
            got = [0] * r["size"]
            for p in r.pieces:
                got[p["first"] : p["first"] + p.n] = [p.times] * p.n
            assert got == words
            place += r["size"]


def test_repeats_keep_the_same_row(spark, docs):
    df = docs([(1, "a b c", "en", "x"), (1, "a b c", "de", "y"), (2, None, "en", "x"), (3, "", "en", None)])
    got = [sorted((r.doc_id, r.lang, r.source) for r in M.mixed_documents(d).collect()) for d in (df, df.orderBy("lang"), df.repartition(5))]
    assert got[0] == got[1] == got[2] and {r[1] for r in got[0]} == {"de"}
