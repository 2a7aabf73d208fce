"""Token ids in binary files: ids ranked by frequency, byte-aligned codes of variable length.

The file format, below one folder, its tables kept as Parquet so that Spark reads and writes them anywhere:

- `ranks` (rank, id, n): the ids that occur, the most frequent first, ties by id.
- `blocks` (part, block, start, docs, lengths, control, data): documents in order, BLOCK_IDS ids or one
  document more. `data` holds each id's rank in 1 to 4 bytes, little-endian, without what is zero in front;
  `control` holds the number of bytes less one, two bits an id, four ids a byte, the first one lowest.
  `start` counts the ids before it in its part.
- `parts` (part, first): the ids in all parts before.

Reading takes four codes at a step by their control byte: numpy looks up how many bytes it stands for and
where each of them goes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import drop, held, release, small, written

#: Ids from which on a block ends.
BLOCK_IDS = 1 << 18
#: Stretches and pre-tokens that a worker remembers (up to twice as many), and the longest of them.
MEMO, LONGEST = 500_000, 64
#: Control bytes that are decoded at a step: bounds what indexes take.
STEP = 1 << 16

#: The normalizer and the splitting rule for which `Words` finds pre-tokens by itself.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: ASCII white space; what is neither that nor an ASCII character one sees nor one of these letters, which
#: normalization only lower-cases; the splitting rule for texts without such.
_SPACE, _LETTERS = "\\t-\\r ", "a-zß-öø-ÿ"
_ODD = re.compile(f"[^{_SPACE}!-~À-ÖØ-öø-ÿ]")
_PLAIN = re.compile(_SPLIT.replace("\\p{L}", _LETTERS).replace("\\p{N}", "0-9").replace("\\s", _SPACE))


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: bytes that print as Latin-1 are themselves, the others come from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _alphabet()


class Memo(dict):
    """make(key) by key, kept for the last MEMO to twice as many keys of at most LONGEST characters."""

    def __init__(self, make: Callable):
        self.make, self.before = make, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[key] = out
        return out


class Words(Memo):
    """Packed ids by stretch of bytes between white space, as the library has them, found where they are missing.

    The library splits a text at white space, marks and letters before it merges, so that equal pre-tokens
    always have equal ids. Where the file's rules are those above, texts are split at ASCII white space, of which
    no pre-token holds any; an ordinary stretch is split into pre-tokens here, which are stretches of their own, and each
    of them is merged by the library once. Stretches with any other character, and all texts for files with other rules, are encoded by the
    library as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._stretch)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.library.model.tokenize
        rules = json.loads(self.library.to_str())
        first = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        split = first.get("pattern") == {"Regex": _SPLIT} and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        known = split and rules["pre_tokenizer"]["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.known = known and rules["normalizer"] == _NORMALIZER and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"

    def _encode(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str) -> bytes:
        # Bytes are merged as characters of the byte-level alphabet, in which those of ASCII that one sees are themselves.
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.kind, [t.id for t in self.merge(word)]).tobytes()

    def _stretch(self, data: bytes) -> bytes:
        text = data.decode()
        if _ODD.search(text):
            return self._encode(text)
        found = _PLAIN.findall(text.lower())
        return self._merged(found[0]) if len(found) == 1 else b"".join([self[t.encode()] for t in found])

    def packed(self, text: str | None) -> bytes:
        """The ids of the whole text, without special tokens; null is the empty text."""
        if not text:
            return b""
        if not self.known:
            return self._encode(text)
        # Bytes are lower-cased and split as ASCII, so that copies of a word in another case are one stretch.
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """(doc, at, row, ids) for every row: its key, the hash of its text, a number that no other row of the
    same run has, and its ids, little-endian in 2 bytes if all ids of the tokenizer fit, else 4. `end` is appended to each.
    The tokenizer file is read where the work is done, so each machine has it at `path`. Other columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held("tokenbin", sys.intern(path), lambda: Words(path))  # interned: the same object in the worker's next task
        last = array(words.kind, [] if end is None else [end]).tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds what Python holds of long texts at once
                part = batch.slice(start, 256)
                ids = pa.array([words.packed(t) + last for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.arange(row, row + len(ids))), ids], names=["doc", "at", "row", "ids"])
                row += len(ids)

    rows = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    more = T.StructType.fromDDL("at long, row long, ids binary").fields
    return rows.select("doc", "at", "text").mapInArrow(run, T.StructType([rows.schema["doc"], *more]))


def id_kind(path: str) -> str:
    """Type code of the packed ids of `tokenize`."""
    return Words(path).kind


def ranks(encoded: DataFrame, kind: str) -> DataFrame:
    """(rank, id, n) of the ids that occur in `encoded` (ids): no more rows than the tokenizer has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                more = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(start, 256).to_pylist()), kind))
                if len(more) > len(n):
                    n, more = more, n
                n[: len(more)] += more
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # one row for each id of the tokenizer at most
    found.sort(key=lambda r: (-r.n, r.id))
    table = pa.table({"rank": pa.array(range(len(found)), pa.int64()), "id": pa.array([r.id for r in found], pa.int64()), "n": pa.array([r.n for r in found], pa.int64())})
    return encoded.sparkSession.createDataFrame(table).coalesce(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = values.astype("<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = more
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: how many data bytes its four values have, and for each of their 16 bytes the place
    among these, or -1 where it is zero."""
    size = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    size += 1
    start = np.cumsum(size, 1) - size
    place = np.where(np.arange(4) < size[:, :, None], start[:, :, None] + np.arange(4), -1)
    return size.sum(1), place.reshape(256, 16)


SIZE, PLACE = _tables()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` values of `pack`."""
    codes = np.frombuffer(control, np.uint8)
    # A last group that is not full has its missing values as bytes that are not there: read as zeros.
    held_bytes = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    size = SIZE[codes]
    start = np.cumsum(size) - size
    out = np.empty((len(codes), 16), np.uint8)
    for low in range(0, len(codes), STEP):
        part = slice(low, low + STEP)
        place = PLACE[codes[part]]
        at = start[part, None] + place
        out[part] = np.where(place >= 0, held_bytes[np.minimum(at, len(held_bytes) - 1)], 0)
    return out.reshape(-1).view("<u4")[:n]


def write(encoded: DataFrame, folder: str, kind: str) -> None:
    """Writes `encoded` (see `tokenize`) to a new `folder`, in ascending order of doc (null last), then the hash of
    the text, then the row.

    Rows are dealt out by ranges of these three, so that no key is too frequent for a task, and sorted in
    their task; what each part has before it comes from one row a part. `encoded` is read several times: write it
    before. The ranks, no more than the tokenizer has ids, are broadcast.
    """
    spark = encoded.sparkSession
    ranks(encoded, kind).write.parquet(f"{folder}/ranks")
    by_rank = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").select("id", "rank").orderBy("rank").collect()], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)
    kinds = T.StructType(
        [
            *T.StructType.fromDDL("part long, block long, start long").fields,
            T.StructField("docs", T.ArrayType(encoded.schema["doc"].dataType)),
            *T.StructType.fromDDL("lengths array<int>, control binary, data binary").fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank, part, block, start, n = shared.value, TaskContext.get().partitionId(), 0, 0, 0
        docs, held_ids = [], []

        def flush() -> pa.RecordBatch:
            control, data = pack(rank[np.concatenate(held_ids)])
            cells = [part, block, start, pa.concat_arrays(docs), [len(x) for x in held_ids], control, data]
            offsets = pa.array([0, len(held_ids)], pa.int32())
            columns = [pa.array([c], pa.int64()) for c in cells[:3]]
            columns += [pa.ListArray.from_arrays(offsets, cells[3]), pa.array([cells[4]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([c], pa.binary()) for c in cells[5:])], names=kinds.names)

        for batch in batches:
            for i in range(batch.num_rows):
                docs.append(batch.column(0).slice(i, 1))
                held_ids.append(np.frombuffer(batch.column(3)[i].as_py(), kind))
                n += len(held_ids[-1])
                if n >= BLOCK_IDS:
                    yield flush()
                    block, start, n = block + 1, start + n, 0
                    docs, held_ids = [], []
        if held_ids:
            yield flush()

    order = [F.asc_nulls_last("doc"), F.col("at"), F.col("row")]
    dealt = encoded.select("doc", "at", "row", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(ids).alias("n")).orderBy("part").collect()  # one row a task
    first, before = [], 0
    for r in sizes:
        first.append((r.part, before))
        before += r.n
    spark.createDataFrame(first, "part long, first long").coalesce(1).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of what `write` wrote: `start` ids stand before the document's in all files,
    `ids` are little-endian unsigned 32-bit integers."""
    by_rank = spark.read.parquet(f"{folder}/ranks").select("id", "rank").orderBy("rank").collect()  # at most the tokenizer's ids
    shared = spark.sparkContext.broadcast(np.array([r.id for r in by_rank], "<u4"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    parts = spark.read.parquet(f"{folder}/parts")
    rows = blocks.join(small(parts, 48), "part").select("docs", "lengths", "control", "data", (F.col("first") + F.col("start")).alias("start"))
    doc = T.StructField("doc", blocks.schema["docs"].dataType.elementType)
    kinds = T.StructType([doc, *T.StructType.fromDDL("start long, n_tokens long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        id_of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column(0).slice(i, 1).flatten()
                lengths = batch.column(1).slice(i, 1).flatten().to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                ids = id_of[unpack(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), int(lengths.sum()))]
                start = ends - lengths + batch.column(4)[i].as_py()
                spans = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(lengths), spans], names=kinds.names)

    return rows.mapInArrow(run, kinds)


def export(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """Tokenizes every whole text of `df`, writes the ids below `folder` and reads them back (see `read`).

    Null and empty texts have no ids but `end`. Repeated rows are documents of their own, each with its ids;
    null keys come last. An empty table gives files without blocks and no rows.
    """
    encoded = tokenize(df, path, key, text, end)
    encoded = written(encoded, "encoded", compression="zstd")
    write(encoded, folder, id_kind(path))
    drop(encoded)
    return read(df.sparkSession, folder)
