"""Loading chunks: upsert, prune, statistics, versions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.functions.shared import exists, written
from lexspark.operators.chunking import within_limit
from lexspark.operators.indexing import POLISH, Analyser, write_index
from lexspark.operators.validation import ValidationError, require_constraints, unpaired, wrong_width
from lexspark.operators.vectors import write_vectors

KEY = ["act", "article", "paragraph", "part_index"]
_NAMED = "seq long, version string"


class Encoder(Protocol):
    """What turns texts into vectors. `dim` is the vectors' width."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in for a model: signed hashed words, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(rows: DataFrame, text, encoder: Encoder, to: str = "embedding", batch: int = 16) -> DataFrame:
    """`rows` with the vector of column `text`, by Arrow batches; the encoder is set up once a task."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for start in range(0, len(part), batch):
                out.extend(encoder.encode(part.iloc[start : start + batch].fillna("").tolist()).tolist())
            yield pd.Series(out, dtype=object)

    return rows.withColumn(to, vectors(text))


def encode_passages(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    return encode(chunks, X.embedding_input(F.col("title_path"), F.col("content")), encoder)


def encode_queries(questions: DataFrame, encoder: Encoder) -> DataFrame:
    return encode(questions, X.query_input(F.col("question")), encoder, "vector")


def upsert(target: DataFrame, load: DataFrame, key: list[str] = KEY, ident: str = "id") -> DataFrame:
    """`target` with the rows of `load`: a row of a known key gets the load's values and keeps its id;
    new keys get ids above the highest, in key order. `load` has all columns of `target` but the id."""
    values = [c for c in target.columns if c not in (*key, ident)]
    old = target.select(*key, ident, F.struct(*values).alias("old"))
    new = load.select(*key, F.struct(*values).alias("new"))
    rows = old.join(new, key, "full_outer").withColumn("v", F.coalesce("new", "old"))
    top = target.agg(F.coalesce(F.max(ident), F.lit(0)).cast("long").alias("top"))
    known = rows.where(F.col(ident).isNotNull())
    return known.select(ident, *key, "v.*").unionByName(_numbered(rows.where(F.col(ident).isNull()), key, top, ident).select(ident, *key, "v.*"))


def _numbered(rows: DataFrame, key: list[str], top: DataFrame, ident: str) -> DataFrame:
    """Ids from top + 1 in key order, without gathering the rows: sorted ranges of keys are written once,
    with each row's place in its range, and a range starts where the counts of those before it end."""
    place = F.monotonically_increasing_id()
    ranged = rows.drop(ident).repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__at", place)
    ranged = written(ranged, "ranged")
    part = F.shiftright("__at", 33)
    before, shifts = 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a task
        shifts.append((r.part, before - (r.part << 33)))
        before += r["count"]
    shifts = rows.sparkSession.createDataFrame(shifts, "__part long, __shift long")
    out = ranged.join(F.broadcast(shifts), part == F.col("__part")).crossJoin(F.broadcast(top))
    return out.withColumn(ident, F.col("top") + F.col("__at") + F.col("__shift") + 1).drop("__at", "__part", "__shift", "top")


def prune(target: DataFrame, load: DataFrame, key: list[str] = KEY, act: str = "act") -> DataFrame:
    """`target` without rows of the loaded acts that the load does not have; other acts stay."""
    loaded = load.select(act).distinct()
    here, elsewhere = target.join(loaded, act, "left_semi"), target.join(loaded, act, "left_anti")
    return elsewhere.unionByName(here.join(load.select(*key).distinct(), key, "left_semi").select(*elsewhere.columns))


def stale(target: DataFrame, load: DataFrame, key: list[str] = KEY, act: str = "act") -> DataFrame:
    """The rows that `prune` drops."""
    here = target.join(load.select(act).distinct(), act, "left_semi")
    return here.join(load.select(*key).distinct(), key, "left_anti")


def load_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_distinct("article").alias("articles"),
        F.count_if(F.col("embedding").isNull()).alias("unembedded"),
        F.count_if("repealed").alias("repealed"),
    )


def load(
    spark: SparkSession,
    path: str,
    chunks: DataFrame,
    encoder: Encoder,
    version: str,
    previous: str | None = None,
    pruned: bool = True,
    analyser: Analyser = POLISH,
    cells: int | None = None,
) -> DataFrame:
    """Writes the next version of the table and its index below `path` and returns its statistics. With `cells` the
    version has a vector index of so many cells, too.

    In order: the model's limit, encoding, the width of every vector and that there is one for each chunk, upsert
    into the previous version, pruning, the table's constraints, index. Readers see a version only once `current` names it last, which is
    done at the end.
    An empty load changes nothing.
    """
    if not chunks.limit(1).count():
        return load_stats(spark.read.parquet(f"{path}/{previous}/chunks")) if previous else None
    rows = written(encode_passages(within_limit(chunks), encoder), "encoded")
    if bad := wrong_width(rows, encoder.dim).count():
        raise ValidationError(f"{bad} vectors have another width than the declared {encoder.dim}")
    paired = unpaired(chunks.select(*KEY), rows.where("embedding is not null").select(*KEY), KEY).first()
    if paired.missing or paired.chunks != paired.vectors:
        raise ValidationError(f"{paired.vectors} vectors for {paired.chunks} chunks")
    if previous:
        table = upsert(spark.read.parquet(f"{path}/{previous}/chunks"), rows)
        table = prune(table, rows) if pruned else table
    else:
        start = spark.range(1).select(F.lit(0).cast("long").alias("top"))
        table = _numbered(rows.withColumn("id", F.lit(None).cast("long")), KEY, start, "id").select("id", *rows.columns)
    table.write.mode("overwrite").parquet(f"{path}/{version}/chunks")
    done = spark.read.parquet(f"{path}/{version}/chunks")
    require_constraints(done, KEY)
    content = done.select(F.col("id").alias("chunk_id"), X.search_text(F.col("title_path"), F.col("content")).alias("content"))
    write_index(content, path, version, analyser=analyser)
    if cells:
        write_vectors(done.withColumnRenamed("id", "chunk_id"), f"{path}/{version}", cells)
    seq = 1 + max((r.seq for r in _named(spark, path)), default=0)
    spark.createDataFrame([(seq, version)], _NAMED).coalesce(1).write.mode("append").json(f"{path}/current")
    return load_stats(done)


def _named(spark: SparkSession, path: str) -> list:
    """(seq, version) of every load in order: one row a load. The list only grows, so a reader finds the version
    before or the new one at any time."""
    if not exists(spark, f"{path}/current"):
        return []
    return sorted(spark.read.schema(_NAMED).json(f"{path}/current").na.fill(0, ["seq"]).collect())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions in the order in which they were loaded; none of a path without a table."""
    return [r.version for r in _named(spark, path)]


def current_version(spark: SparkSession, path: str) -> str:
    return versions(spark, path)[-1]
