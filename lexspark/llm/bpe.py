"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexspark.llm.common import held

#: Entries of each generation of a worker's memo of pre-tokens.
MEMO = 250_000
#: Pieces of at most so many bytes keep a bucket as one integer, a bit for each position.
SHORT = 256
#: Longer pre-tokens are encoded each time they occur.
MEMO_CHARS = 64
#: The integers of one bit, by its place: positions of short pieces, places in a word, words of ranks.
_BITS = [1 << i for i in range(4096)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Priority queue over ranks 0..size-1. Level 0 has a bit for each rank with a filled bucket, each
    level above a bit for each word of 64 that is not zero below; the next rank is one find-first-set
    for each level. A bucket keeps its positions as a heap, so equal ranks leave leftmost first."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size <= 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for words in self.levels:
            word = rank >> 6
            before = words[word]
            words[word] = before | 1 << (rank & 63)
            if before:
                return
            rank = word

    def pop(self) -> tuple[int, int] | None:
        top = self.levels[-1][0]
        if not top:
            return None
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at << 6 | (word & -word).bit_length() - 1
        rank = at
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            for words in self.levels:
                word = at >> 6
                words[word] &= ~(1 << (at & 63))
                if words[word]:
                    break
                at = word
        return rank, position


class Encoder:
    """Encodes pre-tokens: a linked list of parts, merged in the order of the queue."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(size)
        self.short = SHORT if size <= len(_BITS) << 8 else 0
        self.rank_of = ranks.get
        self.words = [0] * ((size >> 8) + 1)
        self.first = [ranks.get(bytes((i >> 8, i & 255)), -1) for i in range(1 << 16)]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        if n <= self.short:
            return self._short(piece, n)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        push, pop, rank_of = self.queue.push, self.queue.pop, ranks.get
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if pair[i] != rank:  # stale: that pair has changed since
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[gone] = -1
            if end < n:
                before[end] = i
                new = rank_of(piece[i : after[end]])
                if new is None:
                    pair[i] = -1
                else:
                    pair[i] = new
                    push(new, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                new = rank_of(piece[left:end])
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)


    def _short(self, piece: bytes, n: int) -> tuple[int, ...]:
        """The same with the queue inlined: two levels of 256-bit words, buckets as position bits. The lower
        level's words are all 0 again when the queue is empty, and serve the next piece."""
        rank_of, words, first, bit = self.rank_of, self.words, self.first, _BITS
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), []
        top, buckets, i, left = 0, {}, 0, piece[0]
        for right in piece[1:]:
            rank = first[left << 8 | right]
            left = right
            pair.append(rank)
            if rank >= 0:
                if rank in buckets:
                    buckets[rank] |= bit[i]
                else:
                    buckets[rank] = bit[i]
                    word = rank >> 8
                    top |= bit[word]
                    words[word] |= bit[rank & 255]
            i += 1
        pair.append(-1)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 8 | low.bit_length() - 1
            held = buckets[rank]
            at = held & -held
            i = at.bit_length() - 1
            if held == at:
                del buckets[rank]
                bits ^= low
                words[word] = bits
                if not bits:
                    top &= top - 1
            else:
                buckets[rank] = held ^ at
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                rank = pair[i] = rank_of(piece[i : after[end]], -1)
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank] |= bit[i]
                    else:
                        buckets[rank] = bit[i]
                        word = rank >> 8
                        top |= bit[word]
                        words[word] |= bit[rank & 255]
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                rank = pair[left] = rank_of(piece[left:end], -1)
                if rank >= 0:
                    if rank in buckets:
                        buckets[rank] |= bit[left]
                    else:
                        buckets[rank] = bit[left]
                        word = rank >> 8
                        top |= bit[word]
                        words[word] |= bit[rank & 255]
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(rank_of(piece[i:end]))
            i = end
        return tuple(ids)


class Memo(dict):
    """Ids by pre-token, as packed 32-bit integers, at most MEMO of them. What `old`, the generation before,
    has is taken over when it is asked for."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes] | None = None):
        self.encoder, self.old = encoder, {} if old is None else old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.encoder.piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS and len(self) < MEMO:
            self[piece] = ids
        return ids

    def next(self) -> Memo:
        """The generation after a full one; the one before this is dropped."""
        self.old = {}
        return Memo(self.encoder, self)


def latin_pattern(pattern: str) -> str | None:
    """`pattern` for the standard library's matcher, right for texts of U+0000 to U+00FF only: there the
    classes that it names are these short lists. None where it uses what that matcher lacks."""
    letters, numbers, spaces = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
    out = out.replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    return None if "\\p" in out else out


class Codec:
    """Encodes texts to packed ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.memo = Memo(Encoder(ranks))
        self.every = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin = re.compile(latin).findall if latin else self.every
        self.wide = re.compile("[^\x00-\xff]").search
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def packed(self, text: str | None) -> bytes:
        """Each match of the pattern is encoded separately; null is the empty text."""
        if not text:
            return b""
        find = self.latin if text.isascii() or not self.wide(text) else self.every
        if len(self.memo) >= MEMO:
            self.memo = self.memo.next()
        return b"".join(map(self.memo.__getitem__, find(text)))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def bytes_of(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        end = np.cumsum(n)
        if not len(end):
            return b""
        return self.flat[np.repeat(self.start[ids] - end + n, n) + np.arange(end[-1])].tobytes()


def _columns(df: DataFrame, source: str, more: list[T.StructField], make: Callable) -> DataFrame:
    """`df` with columns `more` (replaced if there) that `make` gets from batches of `source`."""
    new = {f.name for f in more}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    fields = [df.schema.fields[i] for i in kept] + more
    names, at = [f.name for f in fields], df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds what Python holds of long texts at once
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *make(part.column(at))], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def _list_array(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None
) -> DataFrame:
    """`df` with array<int> column `ids`: the ids of the whole text, no special tokens. With `decoded`,
    also that binary column: the bytes of these ids, decoded in the same pass.

    The driver reads the rank file (of bounded size: one line a token) and broadcasts it. No shuffle;
    one pass over the rows. Null and empty texts give an empty array; other columns pass through,
    one called like a new one is replaced.
    """
    ranks = _shared(df.sparkSession, ranks_path)
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    more += [T.StructField(decoded, T.BinaryType())] if decoded else []

    def make(texts: pa.Array) -> list[pa.Array]:
        codec = held(f"bpe {pattern}", ranks.value, lambda: Codec(ranks.value, pattern))
        packed = [codec.packed(t) for t in texts.to_pylist()]
        out = [_list_array(packed)]
        if decoded:
            out.append(pa.array([codec.bytes_of(np.frombuffer(p, "<i4")) for p in packed], pa.binary()))
        return out

    return _columns(df, text, more, make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """`df` with binary column `to`: the bytes of the ids. A null array decodes to no bytes."""
    ranks = _shared(df.sparkSession, ranks_path)

    def make(lists: pa.Array) -> list[pa.Array]:
        codec = held(f"bpe {pattern}", ranks.value, lambda: Codec(ranks.value, pattern))
        return [pa.array([codec.bytes_of(np.array(x or [], np.int64)) for x in lists.to_pylist()], pa.binary())]

    return _columns(df, ids, [T.StructField(to, T.BinaryType())], make)


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))
