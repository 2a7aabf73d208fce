"""Language identification, words first.

A known word scores by its log frequency in each language. A word that no language knows is looked up
by its character n-grams, the longest first: of the longest length with a known n-gram, the mean of
the known ones counts. A document's score is the sum over all its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import drop, held, release, small, written

#: Longest n-gram for unseen words; ^ and $ mark the ends of the word.
ORDER = 5
#: What the fit is bounded by: labelled documents of a language (about so many, chosen by hash), their
#: characters, and the characters of all languages together. All words and n-grams of these are learned.
FIT_DOCS, FIT_CHARS, FIT_ALL_CHARS = 3_000, 8_000_000, 64_000_000
#: Cells (words times languages) a worker keeps besides the model; beyond it they are computed anew.
MEMO = 800_000
#: Weight of an unseen event in counts.
SMOOTHING = 0.5
UNDETERMINED = "und"


def letters():
    import regex

    find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    return lambda text: find(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def item_hash(item: str) -> int:
    """64 bits that stand for a word or n-gram in the model."""
    return xxhash.xxh3_64_intdigest(item.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Model:
    """Log frequencies by language, sparse: of the words (0) and of the n-grams of each length, sorted hashes;
    entries start[i] to start[i + 1] of an item have the languages that know it, and by how much its log
    frequency there is above that of an unseen one, which is `base`."""

    languages: list[str]
    tables: list[np.ndarray]
    start: list[np.ndarray]
    of: list[np.ndarray]
    above: list[np.ndarray]
    base: np.ndarray

    def known(self, size: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of `items` the table has, and the vectors of these."""
        table = self.tables[size]
        hashes = np.fromiter(map(item_hash, items), np.int64, len(items))
        at = np.minimum(np.searchsorted(table, hashes), max(0, len(table) - 1))
        here = table[at] == hashes if len(table) else np.zeros(len(items), bool)
        at = at[here]
        low, n = self.start[size][at], self.start[size][at + 1] - self.start[size][at]
        rows = np.repeat(np.arange(len(at)), n)
        entries = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        out = np.tile(self.base[size], (len(at), 1))
        out[rows, self.of[size][entries]] += self.above[size][entries]
        return here, out

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word; of an unseen one the mean of the longest known n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        here, found = self.known(0, words)
        out[here] = found
        left = np.flatnonzero(~here)
        for size in range(ORDER, 0, -1):
            if not len(left):
                break
            pieces = [grams(words[i], size) for i in left]
            number = np.repeat(np.arange(len(left)), [len(p) for p in pieces])
            here, found = self.known(size, [g for p in pieces for g in p])
            number = number[here]
            n = np.bincount(number, minlength=len(left))
            sums = np.zeros((len(left), len(self.languages)))
            np.add.at(sums, number, found)
            out[left[n > 0]] = sums[n > 0] / n[n > 0, None]
            left = left[n == 0]
        return out

    def vector(self, word: str) -> np.ndarray:
        return self.vectors([word])[0]


class Vectors(dict):
    """Row numbers by word into one growing matrix of vectors."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1, MEMO // max(1, len(model.languages)))
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.rows = np.zeros((1024, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        """Adds the words of a text that are not there. A full memo starts anew, with all of these."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > self.most and len(self):
            self.start_anew()
            new = list(dict.fromkeys(words))
        size = len(self)
        while size + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[size : size + len(new)] = self.model.vectors(new)
        self.update(zip(new, range(size, size + len(new)), strict=True))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from the labelled rows of `df`. Null languages and null texts teach nothing.

    The rows are a hash sample, whole texts: of each language about FIT_DOCS documents, fewer where these
    have over FIT_CHARS characters (or the language's share of FIT_ALL_CHARS), but some 20 at least. Counting
    is distributed; what reaches the driver are the counts of the sample's words and n-grams, each as 64
    bits, so its size is bounded by the sample's.
    """
    known = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h")).where("text is not null and lang is not null")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")), "languages")
    most = min(FIT_CHARS, FIT_ALL_CHARS / max(1, sizes.count()))
    part = F.greatest(F.least(FIT_DOCS / F.col("docs"), most / F.greatest("chars", F.lit(1))), 20 / F.col("docs"))
    parts = small(sizes.select(F.col("lang").alias("__lang"), (part * (1 << 20)).alias("part")), F.octet_length("__lang") + 64)
    sample = known.join(parts, F.col("lang") == F.col("__lang")).where(F.pmod("h", F.lit(1 << 20)) < F.col("part")).select("lang", "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found, total = letters(), Counter()
        for batch in batches:
            for name, t in zip(*batch.columns, strict=True):
                name = name.as_py()
                for word, n in Counter(found(t.as_py())).items():
                    total[name, word] += n
                if len(total) > 60_000:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    words = written(
        sample.mapInArrow(count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "words"
    )

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                total = Counter()
                for name, word, n in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True):
                    total[name, 0, word] += n
                    for size in range(1, min(ORDER, len(word) + 2) + 1):
                        for g in grams(word, size):
                            total[name, size, g] += n
                columns = [[k[0] for k in total], [k[1] for k in total], [item_hash(k[2]) for k in total], list(total.values())]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "size", "item", "n"])

    pieces = words.mapInArrow(count_pieces, "lang string, size int, item long, n long")
    found = pieces.groupBy("lang", "size", "item").agg(F.sum("n").alias("n")).toArrow()
    drop(words)
    names = pc.unique(found["lang"]).sort()
    number = pc.index_in(found["lang"], names).to_numpy()
    size, item, n = (found[c].to_numpy() for c in ("size", "item", "n"))
    totals = np.zeros((ORDER + 1, len(names)))
    np.add.at(totals, (size, number), n)
    return _model(names.to_pylist(), number, size, item, n, totals)


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())],
        names=["lang", "item", "n"],
    )


def model_of(languages: list[str], rows) -> Model:
    """A model from (lang, size, item, n, total of its lang and size); size 0 means words."""
    at = {name: i for i, name in enumerate(languages)}
    rows, totals = list(rows), np.zeros((ORDER + 1, len(languages)))
    for name, size, _, _, total in rows:
        totals[size, at[name]] = total
    columns = ([at[r[0]] for r in rows], [r[1] for r in rows], [item_hash(r[2]) for r in rows], [r[3] for r in rows])
    return _model(languages, *(np.array(c, np.int64) for c in columns), totals)


def _model(languages: list[str], lang: np.ndarray, size: np.ndarray, item: np.ndarray, n: np.ndarray, totals: np.ndarray) -> Model:
    """A model from one entry for each language, size and item; totals by size and language."""
    tables, start, of, above = [], [], [], []
    for s in range(ORDER + 1):
        here = np.flatnonzero(size == s)
        here = here[np.argsort(item[here], kind="stable")]
        table, first = np.unique(item[here], return_index=True)
        tables.append(table)
        start.append(np.append(first, len(here)).astype(np.int32))
        of.append(lang[here].astype(np.uint16 if len(languages) < 1 << 16 else np.int32))
        above.append((np.log(n[here] + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32))
    below = np.log(totals + SMOOTHING * (np.array([len(t) for t in tables])[:, None] + 1))
    return Model(languages, tables, start, of, above, np.log(SMOOTHING) - below)


def predictor(model: Model):
    """Text to (language, score): the score is the language's share of the likelihood, 0 to 1."""
    find, vectors = letters(), Vectors(model)

    def predict(text: str | None) -> tuple[str, float]:
        words = find(text)
        if not words or not model.languages:
            return UNDETERMINED, 0.0
        vectors.learn(words)
        rows = np.fromiter(map(vectors.__getitem__, words), np.int64, len(words))
        score = vectors.rows[rows].sum(axis=0)
        share = np.exp(score - score.max())
        best = int(score.argmax())
        return model.languages[best], float(share[best] / share.sum())

    return predict


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with lang_pred and score (replaced if there), one pass without a shuffle.

    Texts that are null or have no letter get `und` and 0. Ties go to the first language by code
    point. Whole texts are scored, however long. The model, whose size the bounds of `fit` bound, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = df.drop("lang_pred", "score")
    at, names = rest.columns.index(text), rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = held("langid", shared.value, lambda: predictor(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = [predict(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *more]))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text is divisible by 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
