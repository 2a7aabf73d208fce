"""URL filter against plain Python."""

import pytest
from pyspark.sql import functions as F

from lexspark.llm import common as C
from lexspark.llm import urls as U

CASES = [
    (None, "", ""), ("no scheme", "", ""), ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x"), ("x://y", "y", ""), ("http://h?a://b/c", "h", ""),
    ("http://É.com#top", "É.com", ""), ("://", "", ""), ("http://a.com/p://q", "a.com", "/p://q"), ("http://a.com/" + "x" * 50_000, "a.com", "/" + "x" * 50_000),
]


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u, *_ in CASES], "u string")
    assert [tuple(r) for r in df.select(*U.host_and_path(F.col("u"))).collect()] == [(h, p) for _, h, p in CASES]


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://x.org/a", "org/", "allow"), ("http://org/a", "org/", "allow"), ("http://x.org", None, "allow"), ("http://xorg/a", None, "allow"),
        ("http://example.org/es/1", "example.org/es/", "block"), ("http://m.example.org/en/12", "example.org/en/1", "block"),
        ("http://myexample.org/en/12", "org/", "allow"), ("http://a.com/fr/", "com/fr/", "allow"), ("http://a.com/fr", None, "allow"), ("http://a.com/de/x", "com/de/", "block"),
    ],
)
def test_rules(spark, url, rule, verdict):
    df = spark.createDataFrame([(1, url, None)], "page_id int, url string, html string")
    (r,) = U.judge(df).collect()
    assert r.rule == rule and (rule is None or r.verdict == verdict)


def ranks(good, bad, edges, rounds):
    hosts = set(good) | set(bad) | {h for e in edges for h in e[:2]}
    out, into = {}, {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    t, d = {h: 0.15 * good.get(h, 0) for h in hosts}, {h: 0.15 * bad.get(h, 0) for h in hosts}
    for _ in range(rounds):
        nt, nd = {h: 0.15 * good.get(h, 0) for h in hosts}, {h: 0.15 * bad.get(h, 0) for h in hosts}
        for a, b, n in edges:
            nt[b] += 0.85 * t[a] * n / out[a]
            nd[a] += 0.85 * d[b] * n / into[b]
        t, d = nt, nd
    return {h: (pytest.approx(t[h], abs=1e-3), pytest.approx(d[h], abs=1e-3)) for h in hosts}


def test_propagation_equals_power_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0), ("e", "d", 1.0), ("d", "e", 1.0)]
    good, bad = {"a": 3.0, "b": 0.0}, {"d": 2.0, "b": 1.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in set(good) | set(bad)], "host string, good double, bad double")
    got = U.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n double"), rounds=60, tolerance=1e-9)
    assert {r.host: (r.trust, r.distrust) for r in got.collect()} == ranks(good, bad, edges, 60)


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a class=x HREF="https://{h}/p">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/1", link("linked.net", "good.org")), (2, "http://bad.com/de/1", None), (3, "http://farm.net/1", link("bad.com")),
        (4, "http://linked.net/1", ""), (5, "http://lone.net/1", "<a href='/in'>"), (6, None, link("bad.com")), (3, "http://farm.net/1", link("bad.com")),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "page_id int, url string, html string, verdict string")
    got = sorted((r.page_id, r.verdict) for r in U.judge(df).collect())
    assert got == [(1, "allow"), (2, "block"), (3, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow")]
    assert U.judge(df.limit(0)).collect() == []
    trust = {r.host: (r.trust, r.distrust) for r in U.judge(df).collect()}
    assert trust["linked.net"][0] > 0 and trust["farm.net"][1] > 0 == trust["lone.net"][0]


def test_every_host_settles_whatever_the_other_seeds(spark, monkeypatch):
    names = [f"h{i}" for i in range(30)]
    edges = [*((a, b, 1.0) for a, b in zip(names, names[1:], strict=False)), ("x", "y", 1.0), ("y", "x", 1.0)]
    good, bad = {"h0": 1.0, "x": 2.0}, {"h29": 1.0, "y": 1.0}
    want = ranks(good, bad, edges, 200)
    links = spark.createDataFrame(edges, "src string, dst string, n double")
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in set(good) | set(bad)], "host string, good double, bad double")
    lone = spark.range(1000).select(F.concat(F.lit("lone"), "id"), F.lit(1e5), F.lit(1e5))
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(seeds.union(lone), links).where("host not like 'lone%'").collect()}
    assert got == want and got["h29"][0] == pytest.approx(0.15 * 0.85**29) and got["h0"][1] == pytest.approx(0.15 * 0.85**29)
    monkeypatch.setattr(U, "MOST_ROUNDS", 5)
    with pytest.raises(RuntimeError):
        U.propagate(seeds, links)


def test_what_hosts_without_links_hold_goes_back_to_the_seeds(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "c", 1.0), ("e", "a", 1.0)]
    good, bad = {"a": 3.0, "e": 1.0}, {"c": 2.0, "b": 1.0}
    hosts = "abcde"
    want = []
    for seed, step in ((good, edges), (bad, [(y, x, n) for x, y, n in edges])):
        total, out = sum(seed.values()), {h: sum(n for x, _, n in step if x == h) for h in hosts}
        now = {h: 0.15 * seed.get(h, 0.0) for h in hosts}
        for _ in range(600):
            lost = sum(now[h] for h in hosts if not out[h])
            now = {h: (0.15 + 0.85 * lost / total) * seed.get(h, 0.0) + sum(0.85 * now[x] * n / out[x] for x, y, n in step if y == h) for h in hosts}
        assert sum(now.values()) == pytest.approx(total)
        want.append(now)
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in hosts], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n double"), tolerance=1e-12, returned=True).collect()}
    assert got == {h: (pytest.approx(want[0][h]), pytest.approx(want[1][h])) for h in hosts}


def test_hubs_are_spread_and_chains_have_no_end(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_LEAST", 4)
    monkeypatch.setattr(C, "HOT_SHARE", 20)
    edges = [*(("hub", f"s{i}", 1.0 + i % 3) for i in range(40)), *((f"s{i}", "hub", 2.0) for i in range(40)), ("s1", "s2", 1.0), ("a", "hub", 1.0)]
    good, bad = {"a": 5.0, "s3": 1.0}, {"s2": 2.0, "hub": 1.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in set(good) | set(bad)], "host string, good double, bad double")
    links = spark.createDataFrame(edges, "src string, dst string, n double")
    found = {r.host: (r.trust, r.distrust) for r in U.propagate(seeds, links).collect()}
    assert found == ranks(good, bad, edges, 200)
    monkeypatch.setattr(U, "MOST_ROUNDS", 60)
    names = [f"h{i}" for i in range(70)]  # a row of more links than the rounds beyond one a host
    links = spark.createDataFrame(list(zip(names, names[1:], [1.0] * 69, strict=False)), "src string, dst string, n double")
    got = {r.host: r.trust for r in U.propagate(spark.createDataFrame([("h0", 1.0, 0.0)], "host string, good double, bad double"), links).collect()}
    assert got["h69"] == pytest.approx(0.15 * 0.85**69)


def test_pages_of_a_hot_host_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.{'org' if i % 5 else 'com'}/{'de/' if i % 7 else ''}{i}", None) for i in range(120)] + [(500, None, None), (501, "no scheme", "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    want = sorted(map(repr, U.judge(df).collect()))
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(C, "HOT_LEAST", 10)
    assert sorted(map(repr, U.judge(df).collect())) == want
