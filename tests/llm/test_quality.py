"""Quality rules against plain Python."""

import random

from pyspark.sql import functions as F

from lexspark.llm import common as C
from lexspark.llm import quality as Q


def measure(text):
    w = [b.decode() for b in (text or "").encode().split()]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def texts(rng):
    out = [None, "", " \n\t ", "a", "a b c d e", "a a a a a a", "x\x0b\x0cy\r\nz \xa0 b", "l1\nl1\n\n\nl1 \nl2", "é😀 " * 30, "#*$%&|<> " * 3, "w " * 20_000]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "c"]) + rng.choice(["a", "b", ""]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(1, 60))))
    return out


def test_measures_and_verdicts(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(texts(rng))]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measure(t), repr(t)
    assert all(not (r.kept and r.base_failed) for r in got.values())


def test_hosts_are_shrunk_and_joined_back(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, "bad", bad if i % 10 else good) for i in range(200)] + [(1000 + i, "good", good) for i in range(600)] + [(5000, "tiny", bad), (5001, "tiny", good), (6000, None, good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    assert not got[0] and got[1000] and got[5001] and not got[5000] and got[6000]  # one failure of two is shrunk
    checked = Q.measures(df)
    by = {r.host: r for r in Q.host_verdicts(checked).collect()}
    mean = 181 / 803
    n = {"bad": (200, 180), "good": (600, 0), "tiny": (2, 1), None: (1, 0)}
    seen = sum(k * (b / k - mean) ** 2 for k, b in n.values()) / 803
    weight = max(2, min(1000, mean * (1 - mean) / (seen - 4 * mean * (1 - mean) / 803) - 1))
    for host, (k, b) in n.items():
        assert abs(by[host].rate - (b + weight * mean) / (k + weight)) < 1e-9


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x " * 5)] * 3, "doc_id long, source string, text string")
    assert [r.n_words for r in Q.judge(df).collect()] == [5, 5, 5]
    assert Q.judge(df.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    plan = Q.measures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_column_of_a_verdicts_name_stays(spark, docs):
    df = docs([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(20)))]).withColumn("host_failed", F.lit("mine")).withColumn("host", F.lit(1))
    got = {r.doc_id: (r.host_failed, r.host, r.base_failed) for r in Q.judge(df).collect()}
    assert got == {1: ("mine", 1, True), 2: ("mine", 1, False)}


def test_hot_hosts_beyond_the_broadcast(spark, monkeypatch):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, [None, "bad", "a", "bad", "b", ""][i % 6], bad if i % 6 in (1, 3) or i % 11 == 0 else good) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(repr, Q.judge(df).collect()))
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(C, "HOT_LEAST", 20)
    assert sorted(map(repr, Q.judge(df).collect())) == want and len(want) == 300
