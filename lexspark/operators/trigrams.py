"""Fuzzy lookup of short values, such as citations, by their trigrams.

A value is padded by two blanks at both ends and cut into trigrams. An edit touches three of them at most, so two values
within `edits` edits share at least as many distinct trigrams as the one with more has, less three for each edit. Values
that share so many are verified. Where that number is not positive for a pair, both are so short that they meet by what
is left of them without some characters instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.sizes import bounded, text_bytes


def trigrams(value: Column | str) -> Column:
    """Array of the distinct trigrams of the padded value."""
    padded = F.concat(F.lit("  "), value, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda at: F.substring(padded, at, F.lit(3))))


def trigram_index(values: DataFrame, value: str) -> DataFrame:
    """(value, gram, n): distinct values with their trigrams and how many each has. Null has none."""
    rows = values.select(F.col(value).alias("value")).where("value is not null").distinct().withColumn("grams", trigrams("value"))
    return rows.select("value", F.explode("grams").alias("gram"), F.size("grams").alias("n"))


def _left(values: DataFrame, edits: int) -> DataFrame:
    """`values` with key: what is left of `value` without up to `edits` characters."""
    rows = values.withColumn("key", F.col("value"))
    for _ in range(edits):
        at = F.sequence(F.lit(0), F.greatest(F.length("key") - 1, F.lit(0)))
        cut = F.transform(at, lambda i: F.concat(F.substring("key", F.lit(1), i), F.substring("key", i + 2, F.length("key"))))
        rows = rows.withColumn("key", F.explode(F.array_distinct(F.array_append(cut, F.col("key"))))).distinct()
    return rows


def fuzzy_pairs(index: DataFrame, asked: DataFrame, edits: int = 1) -> DataFrame:
    """(asked, value): for each distinct `asked` (asked) the values of the index within `edits` edits of it."""
    own = asked.select(F.col("asked").alias("value")).where("value is not null").distinct()
    grams = trigram_index(own, "value").toDF("asked", "gram", "m")
    most = F.greatest("n", "m") - 3 * edits
    shared = index.join(bounded(grams, text_bytes("asked", "gram")), "gram").groupBy("asked", "value", "n", "m").agg(F.count("*").alias("shared"))
    met = shared.where(F.col("shared") >= F.greatest(most, F.lit(1))).select("asked", "value")
    short = index.where(F.col("n") <= 3 * edits).select("value").distinct()
    brief = grams.where(F.col("m") <= 3 * edits).select(F.col("asked").alias("value")).distinct()
    few = _left(short, edits).join(_left(brief, edits).withColumnRenamed("value", "asked"), "key").select("asked", "value")
    return met.union(few).distinct().where(F.levenshtein("asked", "value", edits) >= 0)


def fuzzy_lookup_batch(chunks: DataFrame, asked: DataFrame, edits: int = 1, index: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, article): chunks whose article is within `edits` edits of what `asked` (qid, article) spells. `index`
    is that of the articles, where it has been written before."""
    index = trigram_index(chunks, "article") if index is None else index
    pairs = fuzzy_pairs(index, asked.select(F.col("article").alias("asked")), edits).withColumnRenamed("value", "article")
    found = pairs.join(asked.select("qid", F.col("article").alias("asked")), "asked").select("qid", "article")
    return chunks.select("chunk_id", "article").join(bounded(found, text_bytes("article")), "article").select("qid", "chunk_id", "article")
