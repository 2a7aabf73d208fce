"""Line dedup against a plain edit distance over all pairs of lines."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from lexspark.llm import catalog as Q
from lexspark.llm import lines as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, order, tau, min_words):
    seen, out = [], {}
    for i in order:
        key, text = rows[i]
        kept = []
        for line in (text or "").split("\n"):
            if len(line.encode().split()) >= min_words:
                if any(x == line or (abs(len(x) - len(line)) <= tau and edits(x, line) <= tau) for x in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def changed(rng, line):
    s = list(line)
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(s))
        s[at : at + rng.randint(0, 1)] = rng.choice(["", "é", "q", "😀"])
    return "".join(s)


def test_dropped_lines_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", 4)
    rng = random.Random(11)
    base = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 14))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, base[0] + "\n" + base[0]), (4, "a b c " * 4000 + "\n" + base[1])]
    for i in range(60):
        rows.append((5 + i, "\n".join(changed(rng, rng.choice(base)) for _ in range(rng.randint(1, 6)))))
    rows.append((None, base[2] + "\n" + base[3]))
    df = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in L.drop_duplicate_lines(df, tau=2, min_words=3).collect()}
    want = brute(rows, range(len(rows)), 2, 3)
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        assert got[key].text == want[i], key
        assert got[key].n_lines == (len(text.split("\n")) if text is not None else 0)
        assert got[key].n_lines - len(got[key].gone_lines) == (len(want[i].split("\n")) if want[i] else 0) or want[i] in ("", None)


def test_repeated_rows_and_empty_table(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, line), (1, line), (2, line + "!")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in L.drop_duplicate_lines(df).collect())
    assert got == [(1, line), (1, line), (2, "")]
    assert L.drop_duplicate_lines(df.where(F.lit(False))).collect() == []


def test_shuffled_side_gives_the_same(spark, monkeypatch):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(i, f"{line}\nline {i} stays as it is, being none like it {i * 7919}") for i in range(20)], "doc_id long, text string")
    first = sorted(map(tuple, L.drop_duplicate_lines(df).select("doc_id", "text").collect()))
    monkeypatch.setattr("lexspark.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr(L, "small", lambda side, _: side)
    assert sorted(map(tuple, L.drop_duplicate_lines(df).select("doc_id", "text").collect())) == first
    assert sum(line in t for _, t in first) == 1


def test_edit_kernel():
    rng = random.Random(2)
    for _ in range(5000):
        tau = rng.choice([1, 2, 3])
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        b = changed(rng, a)
        assert L.within(a, b, tau) == (edits(a, b) <= tau)
        if edits(a, b) <= tau < min(len(a), len(b)):
            assert set(L.line_keys(a, tau, {})) & set(L.line_keys(b, tau, {}))


def test_short_lines_in_the_query(spark, tmp_path):
    rng = random.Random(5)
    lines = ["", " ", "ab", "ac", "ab", "短い行", "短い行", "And therhean is the is esndha."] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(4))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    gone, seen = {r.doc_id: list(r.gone_lines) for r in Q.op10_line_dedup(spark, str(tmp_path)).collect()}, []
    for key, text in rows:
        out = []
        for i, line in enumerate(text.split("\n")):
            if line.split():
                if any(x == line or (min(len(x), len(line)) > 2 and edits(x, line) <= 2) for x in seen):
                    out.append(i)
                seen.append(line)
        assert gone[key] == out


def test_short_lines_in_the_pipeline(spark, docs):
    df = docs([(1, "短い行\nAnd so on."), (2, "短い行\nAnd so on.\nthe rest is here")])
    assert sorted((r.doc_id, r.text) for r in C.line_dedup(spark, df, "").collect()) == [(1, "短い行\nAnd so on."), (2, "the rest is here")]


def test_edits_grow_with_the_line_in_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_LINES", 4)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé😀") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (8, 11, 12, 13, 14, 16, 20, 30, 45, 70)] + ["a b c " * 30]
    rows = []
    for i in range(70):
        line = rng.choice(base)
        for _ in range(rng.randint(0, 1 + len(line) // 60)):
            at = rng.randint(0, len(line))
            line = line[:at] + rng.choice(["", rng.choice(words), "q"]) + line[at + rng.randint(0, 4) :]
        rows.append((i, line + "\n" + rng.choice(base)[: rng.randint(50, 90)]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    gone = {r.doc_id: list(r.gone_lines) for r in Q.op10_line_dedup(spark, str(tmp_path)).collect()}
    seen, beyond = [], 0
    for key, text in rows:
        out = []
        for i, line in enumerate(text.split("\n")):
            least = min((edits(x, line) / max(2, min(len(x), len(line)) // 20) for x in seen), default=9)
            beyond += least <= 1 and all(edits(x, line) > 2 for x in seen)
            if least <= 1:
                out.append(i)
            seen.append(line)
        assert gone[key] == out, key
    assert beyond > 5


def test_gram_keys_and_reach():
    rng = random.Random(4)
    often = L.np.zeros(L.BUCKETS, "uint8")
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(60, 200)))
        b = a
        for _ in range(rng.randint(0, len(a) // 15)):
            at = rng.randint(0, len(b))
            b = b[:at] + rng.choice(["", "b", "c"]) + b[at + rng.randint(0, 1) :]
        most = L.allowed(min(len(a), len(b)), 2, 20)
        near = edits(a, b) <= most
        assert L.within(a, b, most) == near
        if near and min(len(a), len(b)) >= 60:
            x, y = (set(L.gram_keys(L.gram_order(L.gram_hashes(s), often), L.allowed(len(s), 2, 20)).tolist()) for s in (a, b))
            assert x & y


def test_many_lines_of_one_beginning(spark):
    rng = random.Random(3)
    base = "The same beginning of all these lines, "
    lines = [base + "".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(20_000)]
    again = [lines[i][:-1] + "zz" for i in range(0, 20_000, 1000)]
    df = spark.createDataFrame([(i, "\n".join(lines[i * 20 : i * 20 + 20])) for i in range(1000)] + [(5000 + i, x) for i, x in enumerate(again)], "doc_id long, text string")
    got = {r.doc: r.gone for r in L.duplicate_lines(df).collect()}
    assert got == {5000 + i: [0] for i in range(20)}


def test_signatures_of_near_lines_are_near():
    rng = random.Random(14)
    for _ in range(2000):
        a = "".join(rng.choice("abc é😀") for _ in range(rng.randint(1, 40)))
        b = changed(rng, a)
        apart = int(L.np.bitwise_count(L.signature(a) ^ L.signature(b)).sum()) if a and b else 0
        assert apart <= 4 * edits(a, b)


def test_lines_far_apart_in_place_or_length_do_not_meet():
    rng = random.Random(8)
    key = L.np.array([rng.randint(1, 40) for _ in range(600)])
    line = L.np.array([rng.randint(0, 1 << 32) for _ in range(600)])
    size, place = (L.np.array([rng.randint(60, 400) for _ in range(600)]) for _ in "ab")
    place[::9] = L.ANY
    pairs, hot, _ = L.met_pairs(key, line, size << 16 | place, 2, 20)
    want = set()
    for i in range(600):
        for j in range(i):
            most = L.allowed(int(min(size[i], size[j])), 2, 20)
            near = abs(int(place[i] - place[j])) <= most or L.ANY in (place[i], place[j])
            if key[i] == key[j] and abs(int(size[i] - size[j])) <= most and near and line[i] != line[j]:
                want.add((min(int(line[i]), int(line[j])), max(int(line[i]), int(line[j]))))
    assert len(hot) == 0 and {(p >> 32 & L.IDS, p & L.IDS) for p in pairs.tolist()} == want
    assert len(want) < 0.1 * sum(n * (n - 1) // 2 for n in L.np.bincount(key).tolist())


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij ") for _ in range(170))
    lines = []
    for _ in range(240):
        line = base
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(line))
            line = line[:at] + rng.choice(["", "x", "é"]) + line[at + rng.randint(0, 1) :]
        lines.append(line)
    n = len(lines)
    pairs, hot, held = L.met_pairs(L.np.full(n, 7), L.np.arange(n), L.np.full(n, 170 << 16 | 5), 2, 20)
    assert len(pairs) == 0 and len(set(hot.tolist())) == 1 and sorted(held.tolist()) == list(range(n))
    got = {r.doc for r in L.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), per=20).collect()}
    near = lambda a, b: a == b or L.within(a, b, L.allowed(min(len(a), len(b)), 2, 20))
    want = {i for i in range(n) if any(near(lines[j], lines[i]) for j in range(i))}
    assert got == want and 0 < len(want) < n - 1


def test_signatures_of_many_lines():
    rng = random.Random(15)
    lines = ["x", "ab", "é😀 q", *("".join(rng.choice("abc é😀") for _ in range(rng.randint(1, 90))) for _ in range(5000))]
    assert (L.signatures(lines).view("uint64") == L.np.stack([L.signature(x) for x in lines])).all()
    assert L.signatures([]).shape == (0, 4)


def test_counts_of_near_lines_are_near():
    rng = random.Random(16)
    told = 0
    for _ in range(600):
        a = "".join(rng.choice("abc é😀") for _ in range(rng.randint(100, 300)))
        b = "".join(rng.choice("abc é😀") for _ in range(200)) if rng.random() < 0.3 else a
        for _ in range(rng.randint(0, 18)):
            at = rng.randint(0, len(b))
            b = b[:at] + rng.choice(["", "q", "a"]) + b[at + rng.randint(0, 1) :]
        most = L.allowed(min(len(a), len(b)), 2, 20)
        assert L.near_lines(a, b, most) == L.within(a, b, most)
        told += L.np.abs(L.bigram_counts(a) - L.bigram_counts(b)).sum() > 4 * most
    assert told > 100


def test_many_pairs_at_once_and_pairs_that_meet_once():
    rng = random.Random(17)
    pairs = []
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdé", "ab😀c"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) if rng.random() < 0.2 else changed(rng, changed(rng, changed(rng, a)))
        pairs.append((a, b, rng.choice([0, 1, 2, 3, 5, 8, 21, 63, 64])))
    a, b, most = zip(*pairs, strict=True)
    assert L.near_many(list(a), list(b), L.np.array(most)).tolist() == [edits(x, y) <= m for x, y, m in pairs]
    often, told = L.np.zeros(L.BUCKETS, "uint8"), 0
    letters = "abcdefghijklmnopqrstuvwxyz "
    for i in range(300):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(60, 300)))
        b = a
        for _ in range(rng.randint(0, len(a) // 20)):
            at = rng.randint(0, len(b))
            b = b[:at] + rng.choice(["", "b", "c"]) + b[at + rng.randint(0, 1) :]
        if i % 2:  # these share one stretch only
            b = "".join(rng.choice(letters) for _ in range(50)) + a[50:62] + "".join(rng.choice(letters) for _ in range(len(a) - 62))
        if min(len(a), len(b)) < 60:
            continue
        line, key, place = L._long_keys([a, b], often, 2, 20)
        key = L.np.unique(key, return_inverse=True)[1]
        size = L.np.array([len(a), len(b)])[line]
        again = lambda v: L.np.concatenate([v, v])  # noqa: E731  (each line's keys given by two tasks)
        pairs, n, need, _, _ = L.met_often(again(key), again(line), again(size << 16 | place), 2, 20)
        if L.within(a, b, L.allowed(min(len(a), len(b)), 2, 20)):
            assert len(pairs) == 1 and n[0] >= need[0] == 2
        told += bool(len(pairs)) and n[0] < need[0]
    assert told > 5


def test_a_crowd_at_many_keys_is_compared_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "_near_in_blocks", lambda members, texts, tau, per: seen.append(members.groupBy("k").count().count()) or found(members, texts, tau, per))
    found = IN_BLOCKS
    rng = random.Random(18)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    lines = []
    for _ in range(120):
        line = base
        for _ in range(rng.randint(6, 14)):
            at = rng.randint(0, len(line))
            line = line[:at] + rng.choice(["", "x", "é"]) + line[at + rng.randint(0, 1) :]
        lines.append(line)
    got = {r.doc for r in L.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), per=20).collect()}
    near = lambda a, b: L.within(a, b, L.allowed(min(len(a), len(b)), 2, 20))
    assert got == {i for i in range(120) if any(near(lines[j], lines[i]) for j in range(i))}
    assert all(n <= 12 for n in seen)


IN_BLOCKS = L._near_in_blocks
