"""Readers and writers: tables, manifest, gold set, metrics history, fetched files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.sources import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _missing(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The acts of a manifest, one row each; its comment is not read."""
    acts = T.StructType([T.StructField("acts", T.ArrayType(schemas.struct(schemas.ACT)))])
    return spark.read.schema(acts).json(path, multiLine=True).select(F.inline("acts"))


def write_manifest(acts: DataFrame, path: str, comment: Column | None = None) -> None:
    """The acts as one document (with its comment), null fields kept."""
    row = acts.agg(F.sort_array(F.collect_list(F.struct("slug", F.struct(*acts.columns).alias("act")))).alias("a"))
    fields = [F.transform("a", lambda x: x["act"]).alias("acts")]
    if comment is not None:
        fields.insert(0, comment.alias("$comment"))
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "true"})
    row.select(text).coalesce(1).write.mode("overwrite").text(path)


def manifest_digest(acts: DataFrame) -> DataFrame:
    """(digest): of the pinned state, compact JSON with sorted keys of the acts in order of their slugs."""
    pinned = F.struct("eli", "sha256", "slug", "variant")
    row = acts.agg(F.sort_array(F.collect_list(F.struct("slug", pinned.alias("p")))).alias("a"))
    return row.select(F.sha2(F.to_json(F.transform("a", lambda x: x["p"]), {"ignoreNullFields": "false"}), 256).alias("digest"))


def act_by_slug(acts: DataFrame, slug: str) -> DataFrame:
    """The act's row, or an error that lists the known slugs."""
    found = acts.where(F.col("slug") == slug)
    if not found.limit(1).count():
        known = ", ".join(r.slug for r in acts.select("slug").orderBy("slug").limit(50).collect()) or "none"
        raise KeyError(f"no act with slug {slug!r} (known: {known})")
    return found


def fetched(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_name, bytes, digest) of the files in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes, digest, content) of a table of fetched files: of each the one fetched last."""
    if _missing(spark, path):
        return spark.createDataFrame([], "file_name string, bytes long, digest string, content binary")
    rows = spark.read.schema(schemas.FETCHED).parquet(path).where("error is null")
    last = rows.groupBy("file_name").agg(F.max("turn").alias("turn"))
    return rows.join(last, ["file_name", "turn"]).select("file_name", "bytes", "digest", "content")


def append_fetched(rows: DataFrame, path: str) -> DataFrame:
    """Appends `rows` (file_name, url, content, error) as the table's next turn; returns what failed in it. What
    came is kept even if other files failed, so that the next fetch asks only for those."""
    spark = rows.sparkSession
    last = -1 if _missing(spark, path) else spark.read.schema(schemas.FETCHED).parquet(path).agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0]
    made = {"turn": F.lit(last + 1).cast("long"), "bytes": F.length("content").cast("long"), "digest": F.sha2("content", 256)}
    rows.withColumns(made).select(schemas.struct(schemas.FETCHED).names).write.mode("append").parquet(path)
    now = spark.read.schema(schemas.FETCHED).parquet(path).where(F.col("turn") == last + 1)
    return now.where("error is not null").select("file_name", "url", "error")


def verify_or_pin(acts: DataFrame, files: DataFrame, repin: bool = False) -> DataFrame:
    """Acts with their files: status matches, pinned (first fetch), repinned, mismatch or missing, and
    sha256 as it is to be kept. A mismatch keeps the old pin; `require_verified` makes it an error."""
    both = acts.join(files, "file_name", "left")
    status = (
        F.when(F.col("digest").isNull(), "missing")
        .when(F.col("sha256").isNull(), "pinned")
        .when(F.col("sha256") == F.col("digest"), "matches")
        .otherwise("repinned" if repin else "mismatch")
    )
    keep = F.when(status.isin("pinned", "repinned"), F.col("digest")).otherwise(F.col("sha256"))
    return both.withColumn("status", status).withColumn("sha256", keep)


def require_verified(checked: DataFrame) -> DataFrame:
    bad = checked.where(F.col("status") == "mismatch").select("slug").limit(10).collect()
    if bad:
        raise ValueError(f"checksum mismatch: {[r.slug for r in bad]}")
    return checked


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of JSON lines; a missing file has none, blank lines are skipped."""
    kind = schemas.struct(schemas.GOLD)
    return spark.createDataFrame([], kind) if _missing(spark, path) else spark.read.schema(kind).json(path).where("id is not null")


def write_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Metrics runs; run_seq is their order. A missing file has none."""
    return spark.createDataFrame([], schemas.history()) if _missing(spark, path) else spark.read.schema(schemas.history()).json(path)


def append_run(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Appends runs (context, metrics) after the last one, in order of their timestamps."""
    last = read_history(spark, path).agg(F.coalesce(F.max("run_seq"), F.lit(-1)).alias("m")).first().m
    order = F.row_number().over(Window.orderBy("context.timestamp"))  # the few runs of one call
    rows.select((order + last).cast("long").alias("run_seq"), "context", "metrics").write.mode("append").json(path)


def flat_metrics(history: DataFrame) -> DataFrame:
    """History as (run_seq, layer, metrics map): recall@k and faithfulness, or precision, recall, f1."""
    m = "metrics."
    of_k = F.map_from_entries(F.transform(F.map_entries(m + "recall_at_k"), lambda e: F.struct(F.concat(F.lit("recall@"), e["key"]), e["value"])))
    faith = F.when(F.col(m + "faithfulness").isNotNull(), F.create_map(F.lit("faithfulness"), F.col(m + "faithfulness")))
    retrieval = F.map_concat(of_k, F.coalesce(faith, F.create_map().cast("map<string,double>")))
    audit = F.create_map(*[x for n in ("precision", "recall", "f1") for x in (F.lit(n), F.col(f"{m}{n}"))])
    layer = F.col(m + "layer")
    return history.select("run_seq", layer.alias("layer"), F.when(layer == "retrieval", retrieval).otherwise(audit).alias("metrics"))
