"""From glyphs with positions to page texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the geometry: superscripts are smaller and higher, gaps of this share are spaces.
SIZE_MARGIN, RAISE_MIN, SPACE_RATIO, BODY_MARGIN = 0.6, 2.0, 0.18, 0.5
#: Glyphs of whole lines that a task looks at together.
GLYPHS = 50_000
FURNITURE = (r"(?U)^©\s*Kancelaria\s+Sejmu\s+s\.\s*\d+\s*/\s*\d+\s*$", r"^\d{4}-\d{2}-\d{2}$")


def body_size(glyphs: DataFrame, pages: int | None = None) -> DataFrame:
    """(body_size): the most frequent size, rounded to 2 digits; of two as frequent the smaller. With
    `pages`, of the first so many. No glyphs: an error, since the document must be a scan."""
    first = glyphs if pages is None else glyphs.where(F.col("page") <= pages)
    sizes = first.groupBy(F.round("size", 2).alias("s")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", -F.col("s"))).alias("m")).select((-F.col("m")["col2"]).alias("body_size"))
    return best.select(F.coalesce("body_size", F.raise_error(F.lit("no glyphs; is this a scanned document?")).cast("double")).alias("body_size"))


def right_edge(glyphs: DataFrame, body: DataFrame) -> DataFrame:
    """(right_edge): the furthest x1 of glyphs about as large as the body."""
    near = glyphs.crossJoin(F.broadcast(body)).where(F.abs(F.col("size") - F.col("body_size")) < BODY_MARGIN)
    return near.agg(F.max("x1").alias("right_edge"))


def without_margin(glyphs: DataFrame, edge: DataFrame) -> DataFrame:
    """Glyphs that start left of the body's right edge; without an edge, all."""
    return glyphs.crossJoin(F.broadcast(edge)).where(F.col("right_edge").isNull() | (F.col("x0") <= F.col("right_edge"))).drop("right_edge")


def _pieces(rows: pa.Table) -> pa.RecordBatch:
    """(page, line, text) of whole lines of glyphs (page, line, text, size, x0, x1, bottom, body_size) in order: their
    pieces joined. A piece is the text with what goes before it, a space for a wide gap, ^ where a superscript run
    starts. The baseline is the median bottom of the line's glyphs of the body's size, of its inked ones if none
    is as large: small glyphs do not move it, so they may be the most of a line."""
    starts = _starts(rows)
    of = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    text = rows["text"].combine_chunks()
    size, x0, x1, bottom, body = (rows[c].to_numpy() for c in ("size", "x0", "x1", "bottom", "body_size"))
    ink = pc.fill_null(pc.not_equal(pc.utf8_trim(text, " "), ""), False).to_numpy(zero_copy_only=False)
    small = size < body - SIZE_MARGIN
    some = ~small & ~np.isnan(bottom)
    some |= ink & ~np.isnan(bottom) & ~np.logical_or.reduceat(some, first)[of]
    superscript = ink & small & (_medians(bottom, some, of, first)[of] - bottom > RAISE_MIN)
    before = lambda v: np.concatenate([v[:1], v[:-1]])
    wide = ink & before(ink) & ~starts & (x0 - before(x1) > SPACE_RATIO * np.fmax(size, before(size)))
    raised = superscript & (wide | starts | ~before(superscript))
    pieces = pc.if_else(pa.array(ink), text, pa.scalar(" ", text.type))
    marks = np.flatnonzero(wide | raised)
    if len(marks):
        put = pa.array([" ", "^", " ^"], text.type).take(pa.array(np.where(raised[marks], np.where(wide[marks], 2, 1), 0)))
        put = pc.binary_join_element_wise(put, pieces.take(pa.array(marks)), pa.scalar("", text.type))
        pieces = pc.replace_with_mask(pieces, pa.array(wide | raised), put)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), pc.fill_null(pieces, ""))
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(at) for c in ("page", "line")), pc.binary_join(lists, pa.scalar("", text.type))], names=["page", "line", "text"])


def _starts(rows: pa.Table) -> np.ndarray:
    """Where lines start."""
    out = np.zeros(len(rows), bool)
    out[0] = True
    for c in ("page", "line"):
        v = rows[c].combine_chunks()
        out[1:] |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), True).to_numpy(zero_copy_only=False)
    return out


def _medians(value: np.ndarray, some: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Median of some of the values by line, nan where a line has none. Values that are all equal need no sorting."""
    low = np.minimum.reduceat(np.where(some, value, np.inf), first)
    high = np.maximum.reduceat(np.where(some, value, -np.inf), first)
    out = np.where(low == high, low, np.nan)
    left = np.flatnonzero(some & (low < high)[of])
    if len(left):
        left = left[np.lexsort((value[left], of[left]))]
        begin = np.flatnonzero(np.diff(of[left], prepend=-1))
        n = np.diff(np.append(begin, len(left)))
        out[of[left[begin]]] = (value[left[begin + (n - 1) // 2]] + value[left[begin + n // 2]]) / 2
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_pieces` of batches of glyphs in order: a line that goes on in the next batch waits for it."""
    held, n, least = [], 0, GLYPHS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= least:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_starts(rows))[-1])
            if last:
                yield _pieces(rows.slice(0, last))
            held, n = rows.slice(last).to_batches(), n - last
            least = max(GLYPHS, 2 * n)
    if n:
        yield _pieces(pa.Table.from_batches(held))


def lines(glyphs: DataFrame, body: DataFrame, together: bool = False) -> DataFrame:
    """(page, line, text): pieces in order, white space collapsed and trimmed; page furniture and blank
    lines are out. `together`: a line's glyphs stand side by side in one partition, in order, as a reader of pages
    gives them; then no glyph is shuffled. Else all are shuffled and sorted."""
    rows = glyphs.crossJoin(F.broadcast(body))
    if not together:  # after the join, which may lose the order
        rows = rows.repartition("page", "line").sortWithinPartitions("page", "line", "pos")
    rows = rows.select("page", "line", "text", "size", "x0", "x1", "bottom", "body_size")
    rows = rows.mapInArrow(_joined, T.StructType([glyphs.schema["page"], glyphs.schema["line"], T.StructField("text", T.StringType())]))
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = rows.select("page", "line", text.alias("text")).where("text <> ''")
    for pattern in FURNITURE:
        rows = rows.where(~F.col("text").rlike(pattern))
    return rows


def pages(glyph_lines: DataFrame) -> DataFrame:
    """(number, text): a page's lines in order, joined by \\n."""
    rows = glyph_lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return rows.select(F.col("page").alias("number"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def whole_text(page_texts: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, text): the pages of a document in order, joined by \\n."""
    rows = page_texts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("p"))
    return rows.select(by, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def extract(glyphs: DataFrame, calibration_pages: int | None = 20, together: bool = False) -> DataFrame:
    """(number, text) of a document's glyphs (page, line, pos, text, size, x0, x1, bottom); `together` as in `lines`."""
    body = body_size(glyphs, calibration_pages)
    return pages(lines(without_margin(glyphs, right_edge(glyphs, body)), body, together))
