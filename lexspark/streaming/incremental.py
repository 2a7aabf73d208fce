"""Chunks that arrive as a stream, loaded batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexspark.operators.loading import Encoder, load, versions
from lexspark.sources import schemas


def incremental_load(spark: SparkSession, source: str, path: str, encoder: Encoder, checkpoint: str) -> StreamingQuery:
    """Loads the chunk files that appear in `source` as versions of the table at `path`. Each batch is one version, named
    by the checkpoint's stream and the batch's number, on top of the last other one: a repeated batch writes the
    same version again, an empty one none, and a new checkpoint goes on from what the table has. Batches do not prune,
    since a batch is not the whole of its acts."""

    def batch(rows: DataFrame, number: int) -> None:
        name = f"{json.loads(spark.read.text(f'{checkpoint}/metadata').first().value)['id']}-{number}"
        before = [v for v in versions(spark, path) if v != name]
        load(spark, path, rows, encoder, name, before[-1] if before else None, pruned=False)

    stream = spark.readStream.schema(schemas.struct(schemas.CHUNK)).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
