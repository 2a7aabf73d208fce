"""Keeps a passage index current while documents arrive as files.

    python -m jobs.incremental_index --config jobs/incremental_index.json --documents PATH --out PATH --checkpoint PATH

A file stream takes the documents that the checkpoint has not seen. Each micro-batch becomes one segment of
the index below `out` (see `lexspark.operators.segments`): passages, postings by shard, statistics. A document that
comes again replaces what the index has of it. A segment is named by the checkpoint's stream and the batch's
number, so a batch that is repeated after a failure overwrites itself, and a new checkpoint over an existing index takes all
documents again as new segments, which replace the old ones.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession

from jobs import settings
from lexspark.operators import segments

log = logging.getLogger(__name__)
DOCUMENT = "doc_id long, text string, lang string, source string"


def run(
    spark: SparkSession, documents: str, out: str, checkpoint: str, budget: int = 480, shards: int = 16, files_per_batch: int = 64, merge_from: int = 0
) -> int:
    """Indexes the documents that are new since the last run and returns how many segments were added.

    `documents` is a folder, or a pattern of files and folders, of Parquet (doc_id, text, lang, source; more columns are left
    out), in which files are added and never changed.
    `files_per_batch` bounds a batch. With `merge_from`, so many segments or more are merged into one at the end.
    """
    segments.create(spark, out)
    added: list[str] = []

    def load(rows: DataFrame, number: int) -> None:
        stream = json.loads(rows.sparkSession.read.text(f"{checkpoint}/metadata").first().value)["id"]
        row = segments.add(rows, out, f"{stream}-{number}", budget, shards)
        log.info("read %s, batch %d: wrote %d documents, %d passages, %d postings as segment %d of %s", documents, number, row.documents, row.passages, row.postings, row.seq, out)
        added.append(row.batch)

    files = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    query = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    there = segments.segments(spark, out).count()
    log.info("read %s: %d new batches, %d segments count", documents, len(added), there)
    if merge_from and there >= merge_from:
        last = segments.segments(spark, out).orderBy("seq", ascending=False).first()
        row = segments.merge(spark, out, f"merged-{last.seq}")
        log.info("merged %d segments of %s: wrote %d documents, %d passages, %d postings", there, out, row.documents, row.passages, row.postings)
    return len(added)


if __name__ == "__main__":
    settings.main("incremental_index", ["documents", "out", "checkpoint"], run)
