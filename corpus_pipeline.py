"""Corpus pipeline: language ID, line dedup, near-duplicate removal, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but
the last return the columns of documents. A stage's result is written as Parquet and read again as
the next one's `docs`. No stage is expressed in SQL; tests hold them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, jaccard, langid, lines, mixing
from lexspark.llm.common import discard, scope, ship, small, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told (null or no letter). A null `lang` is filled
    with the prediction, a given one stays. The model is fitted on the labelled documents that are
    not held out; where none has a label, nothing can be told and only letters count."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs, model)
    if not model.languages:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines with a word that are within 2 edits of an earlier one. A document of which no word is
    left goes, unless it had none to begin with."""
    cut = lines.drop_duplicate_lines(docs, tau=2, min_words=1)
    cut = cut.where((F.size("gone_lines") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id and then of the smallest hash of its text, stays of each
    group linked by 80 % of its 5-word shingles, also where doc_ids are null or repeat; of rows with one
    doc_id and text the one whose lang, source and n_chars come first. Texts without words are linked
    with nothing, and stay once a doc_id."""
    first = jaccard.kept_rows(docs, k=5, percent=80)
    first = written(first.select(F.col("doc").alias("__doc"), F.col("at").alias("__at"), (F.col("many") > 1).alias("__again")), "first")
    kept = docs.join(small(first, 72), docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__at")))
    once = kept.where("not __again").select(*docs.columns)
    if not first.where("__again").limit(1).count():
        return once
    again = kept.where("__again").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return once.unionByName(again.select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars").select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by weights 5, 2, 1: a document's taken words, a row for each pass. A null source
    is a source; null texts and texts without words have nothing to take; rows that repeat a doc_id and
    text are one document (see `mixing.mixed_documents`). An empty table gives none."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text, their number, and whether they decode to it, for every
    row, also those that repeat. A null text is the empty one: no ids, which decode to it."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return back.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        discard(spark, "stage")  # of the stage before, whose result has been written
        with scope("stage"):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _shipped(f)) for f in (language_id, line_dedup, near_duplicates, source_mix, token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
