"""Scores ranking settings against questions whose answers are known, and gates them against the first.

    python -m jobs.ranking_study --config jobs/ranking_study.json --documents PATH --questions PATH --out PATH

A question is a text that documents hold word for word; these documents are what a search for it should find. Each setting of
the config ranks the same index. Below `out`:

- `index`: the inverted index and its statistics, written once a run and read once for all settings.
- `truth` (qid, source, doc_id), by source.
- `ranked` (setting, qid, act, article, rank), by setting.
- `questions` (setting, qid, n_truth, first, pool, recall_k, hit_k), by setting.
- `summary` (setting, metric, value, previous, delta, passed), by setting: means over questions, compared with the first setting.

A run replaces the settings that it has and leaves others; the same run again gives the same tables.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings as shared
from lexspark.operators import containment, evaluation, indexing, search

log = logging.getLogger(__name__)
KS = (3, 5, 10)
#: Where a setting says nothing else.
DEFAULT = {"ranking": "bm25", "k1": 1.2, "b": 0.75}


def _replace(rows: DataFrame, path: str, by: str, what: str = "dynamic") -> DataFrame:
    """Writes `rows` in place of the partitions that they have, or (`what` static) of all."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", what).partitionBy(by).parquet(path)
    there = rows.sparkSession.read.schema(rows.schema).parquet(path)
    log.info("wrote %s, which holds %d rows", path, there.count())
    return there


def _summary(per: DataFrame, first: str) -> DataFrame:
    """The gate of every setting's means against those of `first`, as of a run before."""
    of = per.groupBy("setting").agg(
        *[F.avg(f"recall_{k}").alias(f"recall_at_{k}") for k in KS],
        *[F.avg(f"hit_{k}").alias(f"hit_rate_{k}") for k in KS],
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg("pool").alias("pool_recall"),
    )
    values = of.unpivot("setting", [c for c in of.columns if c != "setting"], "metric", "value")
    told = values.where(F.col("setting") == first).select("metric", "value")
    runs = values.select(F.col("setting").alias("layer"), F.lit(2).alias("run_seq"), "metric", "value")
    before = values.select(F.col("setting").alias("layer"), F.lit(1).alias("run_seq"), "metric").join(F.broadcast(told), "metric")
    gated = evaluation.gate(runs.unionByName(before))
    digits = [F.round(c, 6).alias(c) for c in ("value", "previous", "delta")]
    return gated.select(F.col("layer").alias("setting"), "metric", *digits, "passed")


def run(spark: SparkSession, documents: str, questions: str, out: str, settings: Sequence[dict], depth: int = 50) -> DataFrame:
    """Writes the study of `settings` (name, and what differs from DEFAULT) below `out` and returns its summary.

    `documents` is a Parquet table (doc_id, text, source), `questions` one (item_id, text). Questions whose text no document
    has are not scored. `depth` candidates are ranked for each question.
    """
    names = [s["name"] for s in settings]
    if not names or len(set(names)) < len(names):
        raise ValueError("settings need names of their own")
    docs = spark.read.parquet(documents).select("doc_id", "text", "source")
    asked = spark.read.parquet(questions).select("item_id", "text")
    log.info("read %s (%d documents) and %s (%d questions)", documents, docs.count(), questions, asked.count())

    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("act"), F.col("doc_id").cast("string").alias("article"), F.col("text").alias("content"), F.lit(False).alias("repealed"))
    indexing.write_index(chunks.select("chunk_id", "content"), out, "index")
    index, stats, known = indexing.read_postings(spark, out, "index"), indexing.read_index(spark, out, "index")[1], indexing.read_frequencies(spark, out, "index")

    found = containment.containing(docs.select("doc_id", "text"), asked, "doc_id", "item_id")
    truth = found.select(F.col("item").alias("qid"), F.col("doc").alias("doc_id")).join(docs.select("doc_id", "source"), "doc_id")
    truth = _replace(truth.distinct().select("qid", "doc_id", "source"), f"{out}/truth", "source", "static")
    told = truth.select("qid", F.col("source").alias("act"), F.col("doc_id").cast("string").alias("article"))

    ask = asked.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    how = [{k: v for k, v in (DEFAULT | setting).items() if k != "name"} for setting in settings]
    ranked = search.lexical_rankings(chunks, index, stats, ask, how, depth, include_repealed=True, frequencies=known)
    called = F.element_at(F.array(*map(F.lit, names)), F.col("ranking") + 1)
    ranked = ranked.withColumn("qid", F.struct(called.alias("setting"), "qid"))  # a question of each setting is one of its own
    articles = search.collapse_to_articles(ranked, chunks).select("qid.qid", "act", "article", "rank", "qid.setting")
    articles = _replace(articles, f"{out}/ranked", "setting")
    each = [evaluation.per_question(told, articles.where(F.col("setting") == name), KS).select("*", F.lit(name).alias("setting")) for name in names]
    _replace(reduce(DataFrame.unionByName, each), f"{out}/questions", "setting")

    per = spark.read.parquet(f"{out}/questions").where(F.col("setting").isin(names))
    summary = _replace(_summary(per, names[0]).select("metric", "value", "previous", "delta", "passed", "setting"), f"{out}/summary", "setting")
    return summary.where(F.col("setting").isin(names))


if __name__ == "__main__":
    shared.main("ranking_study", ["documents", "questions", "out"], run)
