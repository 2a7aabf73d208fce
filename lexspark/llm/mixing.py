"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of fixed length. Every output
shard draws the number of its slots for each source from a multinomial distribution; a slot number
goes through a pseudorandom permutation of its source's block indexes, and slots meet blocks in a
join on the index. Only the sums of a bounded number of chunks of sources are on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import n_words, release, skew_join, small, written

#: Words of a block, output shards, and the hash buckets whose running sums are taken apart.
BLOCK_WORDS = 64
SHARDS = 256
BUCKETS = 4096
#: Chunks of sources; only their sums are on the driver.
CHUNKS = 1000
#: Slots that one row of the plan stands for.
RUN = 1 << 16
_U = np.uint64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(total: float, at: Callable[[float], tuple[float, float]], weight: float) -> float:
    """The share of weight 1 at which all shares, each stopping at its cap, come to `total`. `at` gives, for a
    level, the weights of those below their cap and the caps of the others, summed."""
    now = total / weight if weight else 0.0
    while True:
        free, full = at(now)
        new = (total - full) / free if free else now
        if new <= now:
            return now
        now = new


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight. A share above cap * size stops there and what is over goes to
    the others by weight, until none is above."""
    both = list(zip(sizes, weights, strict=True))

    def at(now: float) -> tuple[float, float]:
        return sum(w for s, w in both if now * w <= cap * s), sum(cap * s for s, w in both if now * w > cap * s)

    found = level(float(sum(sizes)), at, sum(weights))
    return [min(found * w, cap * s) for s, w in both]


def draw(slots: Sequence[int], shards: int, seed: int, wants: Sequence[int] | None = None) -> np.ndarray:
    """Slots by shard and source; shards get equal numbers if `wants` does not say otherwise. Each shard is a multinomial draw with the chances of what is left of
    the sources' slots, so errors of one shard are made good by the next and the sums come out exact;
    what a draw takes beyond the rest of a source is drawn again among the others."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(slots, np.int64)
    n = int(left.sum())
    out = np.zeros((shards, len(left)), np.int64)
    for shard in range(shards):
        want = n // shards + (shard < n % shards) if wants is None else int(wants[shard])
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            left -= got
            out[shard] += got
            want -= int(got.sum())
    return out


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """`index` through a pseudorandom permutation of 0..size-1: rounds of odd multiplications and
    shifts over the next power of two, walked on until the value is below size."""
    bits = max(1, int(size - 1).bit_length())
    mask, half = _U((1 << bits) - 1), _U(max(1, bits // 2))
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 6, dtype=np.int64).astype(np.uint64)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        for r in range(3):
            x = (x * (keys[2 * r] | _U(1)) + keys[2 * r + 1]) & mask
            x ^= x >> half
        out[todo] = x
        todo[todo] = x >= _U(size)
    return out.astype(np.int64)


def plan(sizes: DataFrame, weights: Sequence[float], cap: float, block_words: int) -> DataFrame:
    """(name, source_no, source_size, target, blocks, slots), written: the sources of `sizes` (source, size),
    numbered in code point order, null last, as the weights go round them.

    Sources are sorted into ranges and numbered within these; the ranges' counts, one row a task, are on
    the driver. The level of the shares takes an aggregate for each time that sources stop at their cap.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    place = F.monotonically_increasing_id()
    found = written(found.repartitionByRange("none", "source").sortWithinPartitions("none", "source").withColumn("place", place), "sources")
    counts = found.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, rows = 0, []
    for r in counts:
        rows.append((r.part, before - (r.part << 33)))
        before += r["count"]
    ranges = F.broadcast(sizes.sparkSession.createDataFrame(rows, "part long, shift long"))
    found = found.join(ranges, F.shiftright("place", 33) == F.col("part"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    found = found.select(F.col("source").alias("name"), (F.col("place") + F.col("shift")).alias("source_no"), "source_size")
    found = written(found.withColumn("weight", weight), "weighed")
    exact = "decimal(38,9)"  # sums that do not depend on the order of rows
    most = F.lit(cap) * F.col("source_size")

    def at(now: float) -> tuple[float, float]:
        free = F.lit(now) * F.col("weight") <= most
        r = found.agg(F.sum(F.when(free, F.col("weight")).cast(exact)), F.sum(F.when(~free, most).cast(exact))).first()
        return float(r[0] or 0), float(r[1] or 0)

    total, weighed = found.agg(F.sum("source_size"), F.sum(F.col("weight").cast(exact))).first()
    share = level(float(total or 0), at, float(weighed or 0))
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.floor(F.lit(cap) * F.col("blocks")))
    found = found.withColumns({"target": F.least(F.lit(share) * F.col("weight"), most), "blocks": blocks})
    return written(found.drop("weight").withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0)), "plan")


def slots(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, slot, source_no, block): the mixture as a table of block references. Shards draw first among
    CHUNKS chunks of the sources, on the driver, then each chunk's sources among its draws."""
    spark, total = sources.sparkSession, sources.count()
    per = max(1, -(-total // CHUNKS))
    chunk = F.floor(F.col("source_no") / per)
    sums = dict(sources.groupBy(chunk.alias("chunk")).agg(F.sum("slots")).collect())
    wants = spark.sparkContext.broadcast(draw([sums.get(i, 0) for i in range(-(-total // per))], shards, seed))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at:
                    yield from _runs(at, held, wants.value, shards, seed)
                    at, held = row[0], []
                held.append(row[1:])
        yield from _runs(at, held, wants.value, shards, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for shard, source, size, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(start, start + n, dtype=np.int64)
                block = np.empty(n, np.int64)
                for turn in np.unique(slot // size):  # each pass over the source has an order of its own
                    at = slot // size == turn
                    block[at] = permuted(slot[at] % size, size, seed * 1_000_003 + source * 1009 + int(turn))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(slot), pa.array(np.full(n, source, np.int64)), pa.array(block)],
                    names=["shard", "slot", "source_no", "block"],
                )

    chunks = sources.select(chunk.alias("chunk"), "source_no", "blocks", "slots").repartition("chunk").sortWithinPartitions("chunk", "source_no")
    chunks = chunks.mapInArrow(runs, "shard int, source_no long, blocks long, start long, n long")
    chunks = chunks.repartition(spark.sparkContext.defaultParallelism * 2, "shard", "source_no", "start")
    return chunks.mapInArrow(run, "shard int, slot long, source_no long, block long")


def _runs(chunk: int | None, held: list[tuple[int, int, int]], wants: np.ndarray, shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Runs (shard, source_no, blocks, start, n) of at most RUN slots for the sources (source_no, blocks, slots) of
    a chunk: the slots of a source are numbered on from shard to shard."""
    if not held:
        return
    counts = draw([s[2] for s in held], shards, seed * 7919 + chunk, wants[:, chunk])
    for number, (source, blocks, _) in enumerate(held):
        rows, at = [], 0
        for shard in range(shards):
            end = at + int(counts[shard, number])
            for start in range(at, end, RUN):
                rows.append((shard, source, blocks, start, min(end, start + RUN) - start))
                if len(rows) == 1 << 16:
                    yield _batch(rows)
                    rows = []
            at = end
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["shard", "source_no", "blocks", "start", "n"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.int64()) for i in range(5)], names=names)


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """`sizes` (doc, at, source, size) with source_no, bucket, no (unique within these two), and start:
    the place of the document's first word in its source's stream.

    The stream runs by bucket, then document, so a running sum needs the rows of one bucket of a
    source only; the buckets' own sums are a few thousand rows a source.
    """
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("named")
    names = sources.select(F.col("name").alias("source"), "source_no", "source_size", "target").select(named, "source_no", "source_size", "target")
    rows = sizes.select(named, "*")
    side = small(names, F.octet_length("named") + 96)
    rows = (skew_join(rows, names, "named") if side is names else rows.join(side, "named")).drop("named")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "at"), F.lit(BUCKETS)))
    order = Window.partitionBy("source_no", "bucket").orderBy("doc", "at", "size")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn(
        "within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    )
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("source_no", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base"))
    return rows.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 17,
) -> DataFrame:
    """(doc, at, source, size, source_size, target, pieces) for every row of `df`: what the mix takes.

    size counts the words (null: 0), source_size and target are the source's. pieces is an array of
    (first, n, times): n words from word `first` are taken `times` times; pieces are in order and
    never overlap, empty where nothing is taken. Weights go round over the sources in code point
    order, null last. `at` is the hash of the text. A seed fixes the whole result; rows that repeat
    are documents of their own. Sources without words have target 0. Other columns are not read.
    """
    sizes = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("at"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    sizes = written(sizes, "sizes")
    sources = plan(sizes, weights, cap, block_words)
    uses = slots(sources, shards, seed).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    uses = uses.hint("merge")  # Spark takes the plan's few rows for its size and would broadcast all blocks
    rows = written(placed(sizes, sources), "placed")
    long = F.lit(block_words).cast("long")
    last = F.col("start") + F.col("size") - 1
    touched = rows.where("size > 0").select(
        "source_no",
        "bucket",
        "no",
        "start",
        "size",
        F.explode(F.sequence(F.floor(F.col("start") / long), F.floor(last / long))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * long)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * long)
    piece = F.struct((low - F.col("start")).alias("first"), (high - low).alias("n"), F.col("times"))
    taken = (
        touched.join(uses, ["source_no", "block"])
        .groupBy("source_no", "bucket", "no")
        .agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    )
    empty = F.array().cast("array<struct<first:bigint,n:bigint,times:bigint>>")
    return rows.join(taken, ["source_no", "bucket", "no"], "left").select(
        "doc", "at", "source", "size", "source_size", "target", F.coalesce("pieces", empty).alias("pieces")
    )


def cut(text: str, pieces: Sequence[tuple[int, int]]) -> str:
    """The words of `text` in `pieces` (first, n), with the white space that stands between them;
    one \\n joins what does not follow on. All words: the whole text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for first, n in pieces:
        if runs and runs[-1][1] == first:
            runs[-1][1] = first + n
        else:
            runs.append([first, first + n])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix as rows of `df`: for each pass r over a document, one row with the words that the mix
    takes at least r times as its text. Documents of which nothing is taken are gone. Rows that share
    key and text are taken for one document, the one whose other columns come first; these have to be
    of types that can be ordered. Null texts, texts without words and empty tables give no rows.
    """
    again = df.groupBy(key, F.xxhash64(text).alias("__at")).count().where("count > 1").limit(1).count()
    if again:  # only then is a shuffle of all texts worth it
        rest = [F.col(c) for c in df.columns if c not in (key, text)]
        first = F.min(F.struct(*rest)).alias("rest") if rest else F.lit(None).alias("rest")
        one = df.groupBy(key, text).agg(first)
        df = one.select(*(F.col(c) if c in (key, text) else F.col(f"rest.{c}").alias(c) for c in df.columns))
    taken = mix(df, key, text, **options)
    taken = taken.where(F.size("pieces") > 0).select(F.col("doc").alias("__doc"), F.col("at").alias("__at"), "pieces")
    most = F.array_max(F.transform("pieces", lambda p: p["times"]))
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    mine = F.filter("pieces", lambda p: p["times"] >= F.col("pass"))
    taken = taken.select("__doc", "__at", F.transform(mine, lambda p: F.struct(p["first"], p["n"])).alias("__pieces"))
    both = df.join(taken, df[key].eqNullSafe(F.col("__doc")) & (F.xxhash64(df[text]) == F.col("__at")))
    both = both.drop("__doc", "__at")
    at, names = df.columns.index(text), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                both = zip(part.column(at), part.column(len(names)), strict=True)
                made = pa.array([cut(t.as_py(), [tuple(p.values()) for p in ps.as_py()]) for t, ps in both], pa.string())
                yield pa.RecordBatch.from_arrays([made if i == at else part.column(i) for i in range(len(names))], names=names)

    return both.mapInArrow(run, df.schema)
