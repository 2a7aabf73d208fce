"""URL filter: rules by host and path, and trust spread over the link graph of hosts.

Built from DataFrame functions only. Where no rule fits a page, its host decides: trust flows from
hosts with allowed pages along the links, distrust flows against them from hosts with blocked pages,
both as personalised PageRank; a host is blocked if distrust has more than a given share of the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import drop, salts_of, side_join, skew_join, written

#: The rules of the query, as verdict and rule.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
HREF = r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING, TOLERANCE = 0.85, 1e-6
#: Rounds beyond one a host after which values that still move are an error. A host is reached within as
#: many rounds as there are hosts; then what comes later shrinks by DAMPING a round, so that it is below
#: TOLERANCE of the smallest double within some 4,450 more: no graph gets here.
MOST_ROUNDS = 5000
#: Rounds that are one job; their result is written.
STEPS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the
    end. Null or no :// : both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as (n, block, rule), else null; of two as long, one that blocks. A
    rule fits its host and all subdomains if the path starts with the rule's. Row by row, by looking
    up each suffix of the host."""
    by_host: dict[str, list[Column]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        entry = F.struct(F.lit(len(rule)).alias("n"), F.lit(verdict == "block").alias("block"), F.lit(rule).alias("rule"), F.lit(slash + rest).alias("path"))
        by_host.setdefault(name, []).append(entry)
    table = F.create_map(*[x for name, found in by_host.items() for x in (F.lit(name), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host. Links within a host are none."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), 1))).alias("dst"))
    found = found.select("src", lower(F.col("dst")).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE, returned: bool = False
) -> DataFrame:
    """(host, trust, distrust) for all hosts of `seeds` (host, good, bad) and `edges` (src, dst, n).

    Each round is a join of ranks and edges and a sum by host, of both vectors at once; STEPS of them
    are one job, whose result is written to the shared folder. It ends when no value of any host moves by
    more than `tolerance` of itself, so never while a host is newly reached, and whatever the other seeds
    are, however many links stand in a row; `rounds`, if given, ends it early instead. Links of a host
    that has many are spread over tasks, and its ranks are sent to each.

    Hosts that link to nobody pass nothing on. With `returned`, what they hold goes back to the seeds, by
    their shares: at the fixed point that is the same vector, scaled to the sum of its seeds.
    """
    found = _propagate(seeds, edges, damping, rounds, tolerance)
    if not returned:
        return found
    found = written(found, "spread")
    sums = [found.agg(F.sum("trust"), F.sum("distrust")).first(), seeds.agg(F.sum("good"), F.sum("bad")).first()]
    scale = [(seed or 0.0) / rank if rank else 1.0 for rank, seed in zip(*sums, strict=True)]
    return found.select("host", *((F.col(c) * x).alias(c) for c, x in zip(("trust", "distrust"), scale, strict=True)))


def _propagate(seeds: DataFrame, edges: DataFrame, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    edges = written(edges, "edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    none, weight = F.lit(0.0), F.col("n") / F.col("all")
    along = skew_join(edges, out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), weight.alias("wt"), none.alias("wd"))
    against = skew_join(edges, into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), none.alias("wt"), weight.alias("wd"))
    moves = written(along.union(against), "moves")
    every = seeds.select("host", "good", "bad").union(moves.select("host", none, none)).groupBy("host")
    own = [((1 - damping) * F.sum(seed)).alias(rank) for seed, rank in (("good", "trust"), ("bad", "distrust"))]
    own = written(every.agg(*own), "own")
    if not moves.limit(1).count():
        return own
    hot = salts_of(moves, "host")
    if hot is not None:
        part = F.pmod(F.xxhash64("to"), F.coalesce("salts", F.lit(1))).cast("int")
        moves = written(moves.join(F.broadcast(hot), "host", "left").select("host", "to", "wt", "wd", part.alias("part")), "moves")

    def step(ranks: DataFrame) -> DataFrame:
        """One round: what comes over links and from the seeds, summed by host."""
        on = ["host"]
        if hot is not None:
            on = ["host", "part"]
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("part")
            ranks = ranks.join(F.broadcast(hot), "host", "left").select("host", "trust", "distrust", parts)
        flow = moves.join(ranks, on).groupBy(F.col("to").alias("host"))
        flow = flow.agg((damping * F.sum(F.col("trust") * F.col("wt"))).alias("trust"), (damping * F.sum(F.col("distrust") * F.col("wd"))).alias("distrust"))
        return own.union(flow).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    ranks, done, most = own, 0, rounds
    if rounds is None:
        most = own.count() + MOST_ROUNDS
    while done < most:
        steps = min(STEPS, most - done)
        new = ranks
        for _ in range(steps - 1):
            new = step(new)
        before = new.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        new = step(new).join(before, "host", "left")
        moved = (F.abs(F.col("trust") - F.col("t")) > tolerance * F.col("trust")) | (F.abs(F.col("distrust") - F.col("d")) > tolerance * F.col("distrust"))
        new = written(new.select("host", "trust", "distrust", moved.alias("moved")), "ranks")
        if done:
            drop(ranks)
        ranks, done = new, done + steps
        if not new.where("moved").limit(1).count():
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust and distrust did not settle within {most} rounds")
    return ranks.select("host", "trust", "distrust")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    url: str = "url",
    html: str = "html",
    max_distrust: float = 0.5,
) -> DataFrame:
    """`pages` without `html`, with host, path, rule (null if none fits), verdict, trust and distrust
    (replaced if there).

    verdict is the rule's; without a rule it is `block` if the host's distrust is more than
    `max_distrust` of its trust and distrust, else `allow`, also for pages without a host and for
    hosts that nothing is known of. Seeds are the numbers of a host's pages that rules allow or block.
    Null urls and htmls, repeated pages and empty tables are fine. Beyond a broadcast's bytes pages meet
    their hosts in a shuffle, but for hot hosts, so that no host crowds one task.
    """
    host, path = host_and_path(F.col(url))
    rest = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    light = rest.drop(html).withColumns({"host": host, "path": path})
    light = light.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = light.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(~F.col("__rule.block"), 1.0).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("__rule.block"), 1.0).otherwise(0.0)).alias("bad")
    )
    linked = host_edges(rest.select(host.alias("host"), F.col(html).alias("html")))
    ranks = written(propagate(seeds, linked, returned=True), "hosts")
    ranks = ranks.select(F.col("host").alias("__host"), "trust", "distrust")
    bad = F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust"))
    by_rule = F.when(F.col("__rule.block"), "block").when(~F.col("__rule.block"), "allow")
    both = side_join(light.withColumn("__host", F.col("host")), ranks, "__host", F.octet_length("__host") + 96).drop("__host")
    return both.withColumns(
        {
            "rule": F.col("__rule.rule"),
            "verdict": F.coalesce(by_rule, F.when(bad, "block").otherwise("allow")),
            "trust": F.coalesce("trust", F.lit(0.0)),
            "distrust": F.coalesce("distrust", F.lit(0.0)),
        }
    ).drop("__rule")
