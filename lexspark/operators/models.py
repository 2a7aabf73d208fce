"""Language models as batch calls that bank their usage."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.shared import written

REPLY = "parsed string, model string, input_tokens long, output_tokens long"


@dataclass(frozen=True)
class Reply:
    """What a model gave: its fields, or None where they did not come out as asked, and what it used."""

    parsed: dict | None
    model: str
    input_tokens: int = 0
    output_tokens: int = 0


class Model(Protocol):
    """A model behind a client, set up on the executors by unpickling."""

    def reply(self, system: str, prompts: list[str]) -> Sequence[Reply]: ...


def called(rows: DataFrame, prompt: Column, model: Model, system: str, kind: str, to: str, batch: int = 16) -> DataFrame:
    """`rows` with struct column `to`: parsed (of `kind`, null where a field is missing), model, input_tokens
    and output_tokens. Prompts go out by Arrow batches. Write the result before it is used twice, or the
    calls are made twice."""

    @F.pandas_udf(REPLY)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for start in range(0, len(part), batch):
                for r in model.reply(system, part.iloc[start : start + batch].tolist()):
                    out.append((None if r.parsed is None else json.dumps(r.parsed), r.model, r.input_tokens, r.output_tokens))
            yield pd.DataFrame(out, columns=["parsed", "model", "input_tokens", "output_tokens"])

    made = rows.withColumn(to, run(prompt))
    parsed = F.from_json(F.col(f"{to}.parsed"), kind)
    names = made.select(parsed.alias("p")).schema["p"].dataType.names
    whole = F.lit(True)
    for name in names:
        whole = whole & parsed[name].isNotNull()
    return made.withColumn(to, F.struct(F.when(whole, parsed).alias("parsed"), *(F.col(f"{to}.{c}").alias(c) for c in ("model", "input_tokens", "output_tokens"))))


def resumed(
    rows: DataFrame, prompt: Column, model: Model, system: str, kind: str, to: str, store: str, slices: int = 16, attempts: int = 3, batch: int = 16
) -> DataFrame:
    """Like `called`, with replies kept below `store` by the digest of what was asked, so that nothing is asked twice: neither
    a prompt that several rows have, nor one of a run before, nor, after a failure, what had been written until then.

    What is missing is asked in `slices` by digest, each written when it is done, so a failure costs one slice at most. A reply
    without the fields that `kind` asks for is asked again, up to `attempts` times in all, and then kept as null. Its tokens
    count each time; `usage_of` sums them. Rows come back with `to` of `called`, tokens of the kept attempt.
    """
    spark, asked = rows.sparkSession, F.sha2(F.concat_ws("\u0001", F.lit(system), F.lit(kind), prompt), 256)
    keyed = rows.withColumn("__asked", asked)
    fields = T.StructType.fromDDL(f"asked string, attempt int, prompt string, call struct<parsed struct<{_fields(kind)}>, model string, input_tokens long, output_tokens long>")
    spark.createDataFrame([], fields).write.mode("append").parquet(store)  # the folder, if it is new
    held = spark.read.schema(fields).parquet(store)
    for attempt in range(1, attempts + 1):
        done = held.groupBy("asked").agg(F.max("attempt").alias("n"), F.bool_or(F.col("call.parsed").isNotNull()).alias("good"))
        left = keyed.select(F.col("__asked").alias("asked"), prompt.alias("prompt")).dropDuplicates(["asked"])
        left = left.join(done.where(F.col("good") | (F.col("n") >= attempt)), "asked", "left_anti")
        if not left.limit(1).count():
            continue
        left = written(left, "prompts")
        for i in range(slices):
            some = left.where(F.pmod(F.xxhash64("asked"), F.lit(slices)) == i)
            made = called(some, F.col("prompt"), model, system, kind, "call", batch).select("asked", F.lit(attempt).alias("attempt"), "prompt", "call")
            made.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("append").parquet(store)
        held = spark.read.schema(fields).parquet(store)
    best = held.groupBy("asked").agg(F.max_by("call", F.struct(F.col("call.parsed").isNotNull(), -F.col("attempt"))).alias(to))
    return keyed.join(best, F.col("__asked") == F.col("asked"), "left").drop("__asked", "asked")


def _fields(kind: str) -> str:
    """`name type, ...` as fields of a struct type."""
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(kind))


def usage_of(spark: SparkSession, store: str) -> DataFrame:
    """(model, calls, input_tokens, output_tokens) of all that was ever asked below `store`."""
    call = spark.read.parquet(store).select("call.*").groupBy("model")
    return call.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def usage_rows(rows: DataFrame, call: str) -> DataFrame:
    """(qid, model, input_tokens, output_tokens) of the calls in column `call`."""
    return rows.select("qid", f"{call}.model", f"{call}.input_tokens", f"{call}.output_tokens")
