"""An inverted index in segments: a load adds one, in proportion to itself, and nothing is rebuilt.

Below one path are tables that are partitioned by `batch`, the name of a segment:

- `documents` (doc_id, lang, source, passages, length): every document of the load, also those without text.
- `passages` (doc_id, part_index, lang, source, content, n_tokens).
- `postings` (doc_id, part_index, lexeme, tf, doc_len), also partitioned by `shard`, a hash of the lexeme.
- `lexemes` (lexeme, df, tf): sums of the segment's postings.
- `segments` (seq, whole, documents, passages, postings): one row a segment, written last.

What has no row in `segments` is not read, so a load that was stopped leaves readers as they were, and repeating it
overwrites what it left. A document that comes again replaces what earlier segments have of it; one without text
is so deleted. Statistics are sums of what segments store less what has been replaced. `merge` writes
what is live as one segment with `whole` set, from which on readers start.

There is one writer at a time. Two would need a lock, which a table of files does not have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import text as X
from lexspark.functions.sizes import bounded
from lexspark.operators import chunking, indexing

KEY = ["doc_id", "part_index"]
TABLES = {
    "documents": "doc_id long, lang string, source string, passages long, length long, batch string",
    "passages": "doc_id long, part_index int, lang string, source string, content string, n_tokens long, batch string",
    "postings": "doc_id long, part_index int, lexeme string, tf long, doc_len long, batch string, shard int",
    "lexemes": "lexeme string, df long, tf long, batch string",
    "segments": "seq long, whole boolean, documents long, passages long, postings long, batch string",
}
SHARDS = 16


def create(spark: SparkSession, path: str) -> None:
    """Makes the tables' folders; what is there stays."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def _write(rows: DataFrame, path: str, name: str, batch: str) -> int:
    """Writes `rows` as the partition `batch` in place of what it has, and returns how many there are."""
    by = ["batch", "shard"] if name == "postings" else ["batch"]
    kinds = T.StructType.fromDDL(TABLES[name])
    rows = rows.withColumn("batch", F.lit(batch)).select(*[F.col(f.name).cast(f.dataType) for f in kinds])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{name}")
    return _read(rows.sparkSession, path, name).where(F.col("batch") == batch).count()


def passages(docs: DataFrame, budget: int = chunking.TOKEN_BUDGET) -> DataFrame:
    """(doc_id, part_index, lang, source, content, n_tokens) of `docs` (doc_id, text, lang, source): lines packed up to the
    budget, longer ones parted at sentences, each passage headed by its document's id. Lines without a character
    but white space are none; a document without lines has no passage."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    pieces = F.transform(lines, lambda x: F.struct(F.lit("").alias("marker"), x.alias("text")))
    rows = docs.withColumn("paragraphs", pieces).where(F.size("paragraphs") > 0)
    path = F.array_compact(F.array("lang"))
    of = rows.select(
        F.struct("doc_id", "lang", "source").alias("act"), F.lit("").alias("article"), F.col("doc_id").cast("string").alias("article_display"),
        path.alias("title_path"), "paragraphs", F.lit(1).alias("page_start"), F.lit(False).alias("repealed"), F.lit("").alias("repeal_kind"), "text",
    )
    return chunking.chunks(of, budget=budget).select("act.doc_id", "part_index", "act.lang", "act.source", "content", "n_tokens")


def _once(docs: DataFrame) -> DataFrame:
    """One row a doc_id, the one whose text has the smallest hash; ties by language and source."""
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source")
    return docs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lexeme").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments that count: from the last whole one on."""
    rows = _read(spark, path, "segments")
    first = rows.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("seq"))), F.lit(0)).alias("first"))
    return rows.crossJoin(F.broadcast(first)).where("seq >= first").drop("first")


def _finish(spark: SparkSession, path: str, batch: str, whole: bool, counts: dict[str, int]) -> Row:
    """Writes the segment's row. A segment that is written again keeps its place among the others."""
    rows = _read(spark, path, "segments")
    held = rows.agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))).alias("own"), F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first()
    row = {"seq": held.own or held.last + 1, "whole": whole, **counts, "batch": batch}
    _write(spark.createDataFrame([row], TABLES["segments"]), path, "segments", batch)
    return Row(**row)


def add(docs: DataFrame, path: str, batch: str, budget: int = chunking.TOKEN_BUDGET, shards: int = SHARDS) -> Row:
    """Adds `docs` (doc_id, text, lang, source) as the segment `batch` and returns its row of `segments`.

    Rows that repeat a doc_id are one document (see `_once`); rows without one are left out. An empty load is an empty
    segment. The same batch again gives the same segment again. Postings are dealt out by shard, which adaptive
    execution parts where a lexeme is in very many passages.
    """
    spark, here = docs.sparkSession, F.col("batch") == batch
    docs = _once(docs.select("doc_id", "text", "lang", "source").where("doc_id is not null"))
    n = {"passages": _write(passages(docs, budget), path, "passages", batch)}
    there = _read(spark, path, "passages").where(here)
    terms = indexing.chunk_terms(there.select(F.struct(*KEY).alias("chunk_id"), "content")).select("chunk_id.*", "lexeme", "tf", "doc_len")
    terms = terms.withColumn("shard", F.pmod(F.xxhash64("lexeme"), F.lit(shards)).cast("int"))
    n["postings"] = _write(terms.hint("rebalance", "shard").sortWithinPartitions("shard", "lexeme", *KEY), path, "postings", batch)
    held = _read(spark, path, "postings").where(here)
    _write(_sums(held), path, "lexemes", batch)
    lengths = held.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    counts = there.groupBy("doc_id").agg(F.count("*").alias("passages"))
    known = docs.select("doc_id", "lang", "source").join(counts, "doc_id", "left").join(lengths, "doc_id", "left")
    n["documents"] = _write(known.na.fill(0, ["passages", "length"]), path, "documents", batch)
    return _finish(spark, path, batch, False, n)


@dataclass(frozen=True)
class Live:
    """What the segments hold that no later one has replaced."""

    documents: DataFrame
    passages: DataFrame
    postings: DataFrame


def replaced(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, batch): documents of segments that count which a later segment has again."""
    rows = _read(spark, path, "documents").join(bounded(segments(spark, path).select("batch", "seq")), "batch")
    last = F.max("seq").over(Window.partitionBy("doc_id"))
    return rows.withColumn("last", last).where("seq < last").select("doc_id", "batch")


def live(spark: SparkSession, path: str) -> Live:
    """The index as it stands."""
    counted, gone = bounded(segments(spark, path).select("batch")), bounded(replaced(spark, path))

    def of(name: str) -> DataFrame:
        return _read(spark, path, name).join(counted, "batch", "left_semi").join(gone, ["doc_id", "batch"], "left_anti")

    return Live(of("documents"), of("passages"), of("postings"))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(n_docs, avgdl) as `indexing.corpus_stats` has them of the passages, from the documents' rows only."""
    passages_, length = F.sum("passages"), F.sum("length")
    avgdl = F.when(passages_ > 0, length / passages_).otherwise(1.0)
    return live(spark, path).documents.agg(F.coalesce(passages_, F.lit(0)).cast("double").alias("n_docs"), avgdl.alias("avgdl"))


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(lexeme, df, tf) of the index as it stands: the segments' sums less what has been replaced, so that no
    more postings are read than those."""
    counted, gone = bounded(segments(spark, path).select("batch")), bounded(replaced(spark, path))
    sums = _read(spark, path, "lexemes").join(counted, "batch", "left_semi").select("lexeme", "df", "tf")
    less = _read(spark, path, "postings").join(gone, ["doc_id", "batch"], "left_semi").select("lexeme", F.lit(-1).cast("long").alias("df"), (-F.col("tf")).alias("tf"))
    return sums.unionByName(less).groupBy("lexeme").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")


def merge(spark: SparkSession, path: str, batch: str) -> Row:
    """Writes what is live as the one segment `batch`, from which on readers start. The segments before stay as
    files that nothing reads."""
    now = live(spark, path)
    n = {"documents": _write(now.documents, path, "documents", batch), "passages": _write(now.passages, path, "passages", batch)}
    terms = now.postings.hint("rebalance", "shard").sortWithinPartitions("shard", "lexeme", *KEY)
    n["postings"] = _write(terms, path, "postings", batch)
    _write(_sums(_read(spark, path, "postings").where(F.col("batch") == batch)), path, "lexemes", batch)
    return _finish(spark, path, batch, True, n)


def ranked_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, index, stats) of the live index as `search.lexical_search` takes them; a chunk's id is its
    document and part."""
    now, key = live(spark, path), F.struct(*KEY).alias("chunk_id")
    chunks = now.passages.select(key, F.col("source").alias("act"), "content", F.lit(False).alias("repealed"))
    return chunks, now.postings.select(key, "lexeme", "tf", "doc_len"), statistics(spark, path)
