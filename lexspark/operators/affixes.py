"""A dictionary of base words and affix rules, expanded to a table (token, lemma).

The files are those of spell checkers: a word list with flags, and rules by flag that say what to take off a
word's beginning or end, what to put there, and which words they are for. Expanding is a join of words and rules
on the flag; what an `Analyser` gets is a plain table, so that looking a token up is a join too, and tokens that it lacks
stay as they are.

Files are UTF-8. What a rule puts on may name flags of its own; such a second suffix is not followed, and these flags are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.sizes import bounded, text_bytes

PREFIX, SUFFIX = "PFX", "SFX"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(f): the fields of each line between white space, without comments."""
    lines = spark.read.text(path)
    kept = F.trim(F.regexp_replace("value", r"^﻿|^#.*|\s#.*$", ""))
    return lines.select(F.split(kept, r"\s+").alias("f")).where(F.get("f", F.lit(0)) != "")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(kind, flag, crossed, strip, put, condition) of the rules of a file: `PFX|SFX flag strip put condition`, where 0 is
    nothing and the header `PFX|SFX flag Y|N count` says whether prefixes and suffixes of the flag go together."""
    rows = _fields(spark, path).where(F.get("f", F.lit(0)).isin(PREFIX, SUFFIX))
    field = lambda i: F.get("f", F.lit(i))
    head = (F.size("f") == 4) & field(2).isin("Y", "N") & field(3).rlike(r"^\d+$")
    heads = rows.where(head).select(field(0).alias("kind"), field(1).alias("flag"), (field(2) == "Y").alias("crossed")).distinct()
    nothing = lambda c: F.when(c == "0", "").otherwise(c)
    put = F.element_at(F.split(field(3), "/"), 1)
    rules = rows.where(~head).select(
        field(0).alias("kind"), field(1).alias("flag"), nothing(F.lower(field(2))).alias("strip"), nothing(F.lower(put)).alias("put"), F.coalesce(F.lower(field(4)), F.lit(".")).alias("condition")
    )
    return rules.join(F.broadcast(heads), ["kind", "flag"], "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


def read_words(spark: SparkSession, path: str, flag: str = "char") -> DataFrame:
    """(word, flags) of a word list, `word/flags` a line. `flag` says how flags are written: one character each (char), two
    (long), or numbers with commas (num)."""
    rows = _fields(spark, path).select(F.split(F.get("f", F.lit(0)), "/").alias("p")).where(~F.get("p", F.lit(0)).rlike(r"^\d+$"))
    given = F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    if flag not in ("char", "long", "num"):
        raise ValueError(f"unknown way of flags {flag!r}")
    each = F.split(given, ",") if flag == "num" else F.regexp_extract_all(given, F.lit("(?s)." if flag == "char" else "(?s).."), F.lit(0))
    return rows.select(F.lower(F.get("p", F.lit(0))).alias("word"), F.array_remove(each, "").alias("flags"))


def _applied(rows: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """`rows` (word, form, ...) with the rules of that kind put on `form`, where they are for it."""
    of = rules.where(F.col("kind") == kind)
    met = rows.join(bounded(of, text_bytes("strip", "put", "condition")), "flag")
    here = lambda rest: F.concat("put", rest) if kind == PREFIX else F.concat(rest, "put")
    return met.where(_fits(kind)).withColumn("form", here(_rest(kind)))


def _fits(kind: str) -> Column:
    """Whether `form` has what the rule takes off, something beside it, and meets the rule's condition."""
    end = F.startswith("form", "strip") if kind == PREFIX else F.endswith("form", "strip")
    pattern = F.concat(F.lit("^"), "condition") if kind == PREFIX else F.concat("condition", F.lit("$"))
    return end & (F.length("form") > F.length("strip")) & F.rlike(F.col("form"), pattern)


def _rest(kind: str) -> Column:
    left = (F.length("form") - F.length("strip")).cast("int")
    return F.substring("form", F.length("strip") + 1, left) if kind == PREFIX else F.substring("form", F.lit(1), left)


def expand(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, lemma), distinct: every word itself, and each form that its flags' rules make of it, its word being the
    lemma. Where rules of a prefix and of a suffix both allow it they go on together, the suffix first. Words without
    flags and flags without rules give the word alone; a form of several words has several lemmas."""
    flagged = words.select("word", F.explode("flags").alias("flag")).distinct().withColumn("form", F.col("word"))
    ended = _applied(flagged, rules, SUFFIX)
    begun = _applied(flagged, rules, PREFIX)
    prefixes = rules.where((F.col("kind") == PREFIX) & F.col("crossed"))
    both = ended.where("crossed").select("word", "form").distinct().join(flagged.select("word", "flag"), "word")
    both = _applied(both, prefixes, PREFIX)
    made = ended.select("form", "word").union(begun.select("form", "word")).union(both.select("form", "word"))
    return words.select("word", F.col("word").alias("w")).union(made).toDF("token", "lemma").where("token is not null and token <> ''").distinct()


def read_dictionary(spark: SparkSession, words: str, rules: str, flag: str = "char") -> DataFrame:
    """(token, lemma) of a word list and a file of rules; an `Analyser` takes it as its lemmas."""
    return expand(read_words(spark, words, flag), read_rules(spark, rules))
