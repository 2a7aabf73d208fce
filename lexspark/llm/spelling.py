"""Spelling variants of words by a symmetric-delete join.

Two words are near if they differ by exactly one inserted, deleted or replaced character. Every word
emits itself and its distinct single deletions; words that emit the same string meet, and are verified.
A near pair has one such string in common: the shorter word, or what is left of both without the place
at which they differ. So each pair is found once, and what meets at a string is bounded by its length times
the characters that occur: strings are rare however frequent a word is.

A word's form is its most frequent near word where that is frequent enough; forms are followed to the
root by doubling the steps each round. Everything is DataFrame functions; counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import drop, skew_join, written

#: Fixed value: the letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, *keep: str, text: str = "text", least: int = 1) -> DataFrame:
    """(`keep`..., run): the maximal runs of LETTERS of at least `least` code points in the whole texts, A-Z
    lower-cased, one row an occurrence. Null and empty texts have none; other columns go."""
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(*keep, F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def without(word: Column | str, at: Column) -> Column:
    """`word` without its code point at `at`, from 0."""
    word = F.col(word) if isinstance(word, str) else word
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, at.cast("int") + 2, F.length(word)))


def vocabulary(words: DataFrame, word: str = "word", least_length: int = 1, least_n: int = 1) -> DataFrame:
    """(word, n): distinct words of at least so many code points and occurrences, of rows of one word each."""
    long = words.where(F.length(word) >= max(1, least_length)).groupBy(F.col(word).alias("word"))
    return long.agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for `words` (word, n; distinct words), each pair of near words once,
    `word` being the first in code-point order."""
    cuts = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda at: without("word", at))
    keys = words.select("word", "n", F.explode(F.array_distinct(F.array_append(cuts, F.col("word")))).alias("key"))
    other = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = keys.join(other, "key").where(F.col("word") < F.col("other"))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) for all `words` (word, n): how many near words each has, and the most
    frequent of them (ties: the first in code-point order) if that has at least `ratio` times its n."""
    ways = [F.struct(F.col(a).alias("word"), (-F.col(m)).alias("m"), F.col(b).alias("other")) for a, b, m in (("word", "other", "other_n"), ("other", "word", "n"))]
    near = near_pairs(words).select(F.inline(F.array(*ways)))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("m", "other")).alias("best"))
    of = words.join(best, "word", "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    return of.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"),
        F.when(fits, -F.col("best.m")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for `links` (word, root; no word twice, no way in circles): each word's link followed to the
    last. Each round a word's link becomes its link's link, so rounds grow with the logarithm of the
    longest way; where many words share a link, they meet what it links to apart (`skew_join`)."""
    now = written(links.select("word", "root"), "links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(skew_join(now, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        drop(now)
        now = new.select("word", "root")
        now._written_at = new._written_at
        if not new.where("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for all `words` (word, n), which are distinct, not null and not
    empty (see `vocabulary`). `ratio` over 1 keeps forms from going in circles. The root is the last
    form, or the word itself if it has none. An empty table gives none."""
    if ratio <= 1:
        raise ValueError("ratio has to be over 1, or two words may be each other's form")
    found = written(forms(written(words.select("word", "n"), "words"), ratio), "forms")
    last = roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
