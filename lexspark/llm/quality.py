"""Quality rules by document and by host.

Built from DataFrame functions only. Rule failures are counted by host (the documents' `source`), the
rates shrunk with a beta prior fitted to all hosts, and each host's verdict goes back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import WORD, side_join, words, written

WINDOW = 5
MIN_WORDS = 10
#: Percent of a document's words that may stand in repeated windows.
MAX_REPEATED = 20
#: A host whose shrunk rate of failing documents is above this fails as a whole.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words of array `w` in 5-word windows that it has twice or more, the first included.

    Windows are compared by hash; only where a hash repeats are the windows themselves sorted and
    compared. Each repeated window counts its words up to the start of the next.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    sorted_windows = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " ").alias("s"), i.alias("i")))
    )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        same = F.filter(
            windows,
            lambda x, k: (x["s"] == F.get(windows, k - 1)["s"]).eqNullSafe(F.lit(True)) | (x["s"] == F.get(windows, k + 1)["s"]).eqNullSafe(F.lit(True)),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).when(twice, let(sorted_windows, repeated)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without `text`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and
    base_failed, which replace columns of those names. Null texts have no words and no lines."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD))
    found = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    rest = [c for c in df.columns if c != text and c not in made]
    out = df.select(
        *rest,
        found.alias("__found"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
    ).select(*rest, "__found.n_words", "__found.word_chars", "n_symbols", "n_dup_lines", "__found.n_repeat_words")
    too_much = 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | too_much)


def host_verdicts(checked: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, bad, rate, host_failed), one row for each value of `host`, null among them.

    The prior is a beta distribution with the mean of all documents and a weight from the moments of
    the hosts' rates: mean * (1 - mean) / (variance beyond chance) - 1, between LEAST_PRIOR and
    MOST_PRIOR documents. rate = (bad + weight * mean) / (n + weight).
    """
    hosts = checked.groupBy(F.col(host).alias("host")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(failed).cast("double")).alias("bad")
    )
    hosts = written(hosts, "hosts")
    mean = F.sum("bad") / F.sum("n")
    overall = hosts.agg(mean.alias("mean"), F.sum("n").alias("docs"), F.count("*").alias("hosts"))
    spread = hosts.crossJoin(overall).agg(
        F.first("mean").alias("mean"),
        (F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)) / F.first("docs")).alias("seen"),
        (F.first("hosts") * F.first("mean") * (1 - F.first("mean")) / F.first("docs")).alias("chance"),
    )
    beyond = F.col("seen") - F.col("chance")
    weight = F.when(beyond > 0, F.col("mean") * (1 - F.col("mean")) / beyond - 1).otherwise(F.lit(MOST_PRIOR))
    prior = spread.select("mean", F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), weight)).alias("weight"))
    rated = hosts.crossJoin(prior).withColumn("rate", (F.col("bad") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight")))
    return rated.select("host", "n", "bad", "rate", (F.col("rate") > max_rate).alias("host_failed"))


def judge(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`measures(df)` with kept: false if the document fails the base rules or its host fails.

    The measures are written once (no text in them); what is joined is one row a host, broadcast if
    its counted size is small; beyond that hosts are shuffled, but for hot ones, which meet their
    documents by broadcast. Every row of `df` comes back, repeated ones too; an empty table gives an
    empty one.
    """
    checked = written(measures(df.drop("kept"), text), "measures")
    verdicts = written(host_verdicts(checked, host, max_rate=max_rate), "verdicts")

    def key(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("__host")

    side = verdicts.select(key("host"), F.col("host_failed").alias("__failed"))
    both = side_join(checked.select("*", key(host)), side, "__host", F.octet_length("__host") + 96)
    return both.select(*checked.columns, (~F.col("base_failed") & ~F.coalesce("__failed", F.lit(False))).alias("kept"))
