"""What the training-data operators share: tables, tables written to the shared folder, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from io import BytesIO
from pathlib import Path
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.shared import shared_dir

#: A word is a longest run of characters outside these six, the ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a small side may have, times its bytes a row, before it is joined by shuffle instead of broadcast.
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch, besides one row: what Python workers and the JVM hold at once of long texts.
ARROW_BYTES, _ARROW = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A join value is hot with over one in so many rows, and so many rows at least.
HOT_SHARE, HOT_LEAST = 1000, 500
#: A key of a similarity join is hot with over one in so many rows.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once a session, so that they need no copy of it, and
    bounds the session's Arrow batches to ARROW_BYTES where it does not say otherwise."""
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    root = Path(__file__).parents[1]
    name = f"{root.name}-{spark.sparkContext.applicationId}.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        return
    held = BytesIO()
    with ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark)}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(held.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)


#: Sessions whose folder goes when the process ends.
_LEAVES: set[str] = set()
#: Folder within the session's, for what is written from here on.
_SCOPE = ["operators"]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexspark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's name in the shared folder that nothing has yet; `discard` deletes what is written there."""
    if spark.sparkContext.applicationId not in _LEAVES:
        _LEAVES.add(spark.sparkContext.applicationId)
        atexit.register(_leave, spark)
    return f"{_session_dir(spark)}/{_SCOPE[-1]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df`, written once to the shared folder and read again: lineage ends there, and a lost
    executor costs no recomputation. `drop` deletes one such table, `discard` many."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a written table that nothing will read again."""
    _delete(table.sparkSession, table._written_at)


def discard(spark: SparkSession, scope: str | None = None) -> None:
    """Deletes every table that this session's operators have written, or those of one scope."""
    _delete(spark, _session_dir(spark) + (f"/{scope}" if scope else ""))


def _leave(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended before
        with suppress(Exception):  # the process ends; there is nobody left to tell
            discard(spark)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to that scope."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of what is run inside hold at most so many bytes, besides one row."""
    before = spark.conf.get(_ARROW, None)
    spark.conf.set(_ARROW, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW)
        else:
            spark.conf.set(_ARROW, before)


def small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, marked for broadcast only if its rows fit the limit by the bytes of each, summed; else a plain
    join side."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: What a worker process has set up for the operator it last ran: name, source, object.
_HELD: list = []


def held(name: str, source: object, make: Callable[[], object]) -> object:
    """make(), kept by the worker process for its later tasks. Only the last operator's is kept, so
    that memos of several stages do not add up in one process."""
    if not _HELD or _HELD[0] != name or _HELD[1] is not source:
        release()
        _HELD.extend((name, source, make()))
    return _HELD[2]


def release() -> None:
    """Drops what the worker process holds for an operator before, and gives freed memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def skew_join(many: DataFrame, one: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """`many` joined with `one`, which has at most one row a value of `on`. Values of over 1 / HOT_SHARE of
    `many`'s rows, of which there are under HOT_SHARE, meet their rows by broadcast, so that a hot value
    does not crowd one task; all others by shuffle. `many` is read several times: write it before."""
    counts = many.groupBy(on).agg(F.count("*").alias("n"))
    least = max(many.count() // HOT_SHARE, HOT_LEAST)
    hot = written(counts.where(F.col("n") > least).select(on), "hot")
    if not hot.limit(1).count():
        return many.join(one, on, how)
    hot = F.broadcast(hot)
    here = many.join(hot, on, "left_semi").join(F.broadcast(one.join(hot, on, "left_semi")), on, how)
    return here.union(many.join(hot, on, "left_anti").join(one, on, how).select(*here.columns))


def salts_of(many: DataFrame, on: str) -> DataFrame | None:
    """(on, salts), written: the hot values of `on` in `many` and into how many fair parts each goes, under
    2 * HOT_SHARE parts in all; None if no value is hot. For joins in a loop, which count once."""
    least = max(many.count() // HOT_SHARE, HOT_LEAST)
    hot = many.groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = written(hot.select(on, F.ceil(F.col("n") / least).cast("int").alias("salts")), "hot")
    return hot if hot.limit(1).count() else None


def side_join(many: DataFrame, one: DataFrame, on: str, row_bytes: int | Column) -> DataFrame:
    """`many` left-joined with `one`, which has at most one row a value of `on`: by broadcast if the bytes of its
    rows, summed, fit BROADCAST_BYTES, else by shuffle, apart from hot values (`skew_join`). `many` is
    read several times then."""
    side = small(one, row_bytes, BROADCAST_BYTES)
    return many.join(side, on, "left") if side is not one else skew_join(many, one, on, "left")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(k, low, id), written: of `keys` (id, k; ids are hashes) the ids of each key that several have, but for
    the least one, low.

    Keys with over 1 in HOT_KEYS rows (there are under HOT_KEYS), seen in one id of 64, are known to be
    shared: their rows need not come together. What is counted there only says which way they go.
    """
    some = keys.where(F.pmod("id", F.lit(64)) == 0).groupBy("k").agg(F.count("*").alias("n"))
    some = written(some, "some")
    most = max(64, (some.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = written(some.where(F.col("n") > most).select("k"), "hot")
    drop(some)
    run = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not hot.limit(1).count():
        return written(keys.withColumn("low", F.min("id").over(run)).where("id <> low").select("k", "low", "id").distinct(), "met")
    cold = keys.join(F.broadcast(hot), "k", "left_anti").withColumn("low", F.min("id").over(run))
    there = written(keys.join(F.broadcast(hot), "k", "left_semi").distinct(), "there")
    lows = written(there.groupBy("k").agg(F.min("id").alias("low")), "lows")
    both = cold.select("k", "low", "id").distinct().union(there.join(F.broadcast(lows), "k").select("k", "low", "id"))
    return written(both.where("id <> low"), "met")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected `edges` (a, b); component is the smallest node reachable.

    Large-star and small-star steps alternate until the edge set stands still, each on a written
    table, of which the one before is deleted. No row group is gathered anywhere: minima are partial
    aggregates, and where a hub is hot, its edges meet its minimum by broadcast (`skew_join`). Empty
    edges, loops and repeats give nothing more; nodes without an edge do not appear.
    """
    now = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark, seen = None, _mark(now)
    while mark != seen and seen[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = skew_join(both, low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where(F.col("a") != F.col("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")  # a holds its neighbours below it here, each a minimum: few
        star = star.select("a", F.col("m").alias("b")).union(star.select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = written(star.where(F.col("a") != F.col("b")).distinct(), "star")
        drop(now)
        drop(large)
        now, mark, seen = new, seen, _mark(new)
    leaf = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaf.union(leaf.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
