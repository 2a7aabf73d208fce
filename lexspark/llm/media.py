"""Media columns: interleaved sequences of text and media.

Pages are parsed into ordered text and media-reference structs; media stand in a store keyed by
digest; references are resolved by a digest join; positions and captions stay with the references.
Payloads are stored as 8-bit grayscale PNG samples, 192 to a row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import release, written
from lexspark.llm.wrappers import TOKEN

ROW = 192
PAD = 32
#: A digest is hot with more than one in so many of all references; its keys are then spread over so many.
HOT_SHARE, SALTS = 2_000, 64
#: zlib level of the stored samples; a fixed value, since it shapes the stored bytes.
LEVEL = 1
_MAGIC = b"\x89PNG\r\n\x1a\n"
_SRC = re.compile(r"""\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MEDIA, _HIDDEN = {"img", "audio", "video", "source", "embed"}, {"script", "style", "template", "noscript"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "br", "wbr"}

ITEM = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_ITEM_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """`payload`, a positive multiple of ROW bytes, as the samples of a grayscale picture."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a picture that `to_png` made; checks magic, checksums and size."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)[:2]
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, as text."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(samples))
    spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(samples)))
    return f"mean={mean:.4f};sd={spread:.4f};bits={float(-(share * np.log2(share)).sum()):.4f}"


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes with spaces up to a positive multiple of ROW."""
    n = F.octet_length(text)
    fill = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(text, F.repeat(F.lit(chr(PAD)), fill)).cast("binary")


def store(payloads: DataFrame, digest: str = "digest", payload: str = "payload") -> DataFrame:
    """(digest, media): each payload once, as PNG. Copies that a task sees again it leaves out (it
    remembers a bounded number of digests); the others fall together in the shuffle by digest.
    Null payloads are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[str] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, names, media = batch.slice(start, 512), [], []
                for name, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if name in seen or not data.is_valid:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    media.append(to_png(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    made = payloads.select(digest, payload).mapInArrow(run, "digest string, media binary")
    return made.dropDuplicates(["digest"])


def items(html: str | None) -> list[dict]:
    """The sequence of a page: texts (white space collapsed) and media, in page order. A medium's
    digest is what its src has after `digest:`, else null; its caption the figcaption of its figure,
    else its alt text, else null. Hidden content is left out."""
    out: list[dict] = []
    words: list[str] = []
    hidden = None
    figure: list[dict] | None = None
    caption: list[str] | None = None

    def flush():
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append({"pos": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    for m in TOKEN.finditer(html or ""):
        closing, name, rest, text = m[1], (m[2] or "").lower(), m[3] or "", m[4]
        if hidden:
            hidden = None if name == hidden and closing else hidden
        elif text is not None:
            (words if caption is None else caption).append(unescape(text))
        elif name in _HIDDEN and not closing:
            hidden = name
        elif name in _MEDIA and not closing:
            flush()
            src = _SRC.search(rest)
            src = unescape(next((g for g in src.groups() if g is not None), "")) if src else ""
            alt = re.search(r"""\salt\s*=\s*(?:"([^"]*)"|'([^']*)')""", rest, re.I)
            alt = " ".join(unescape(alt[1] or alt[2] or "").split()) if alt else ""
            if not src and name in ("audio", "video"):
                continue
            out.append({"pos": len(out), "kind": "media", "text": None, "digest": src[7:] if src.startswith("digest:") else None, "caption": alt or None})
            if figure is not None:
                figure.append(out[-1])
        elif name == "figure":
            flush()
            figure = None if closing else []
        elif name == "figcaption":
            if closing and caption is not None:
                said = " ".join("".join(caption).split())
                if figure:
                    for x in figure:
                        x["caption"] = said or x["caption"]
                elif said:
                    words.append(f" {said} ")
                caption = None
            elif not closing:
                caption = []
        elif name and name not in _INLINE:
            flush() if caption is None else caption.append(" ")
        elif name == "br":
            (words if caption is None else caption).append(" ")
    if caption:
        words += caption
    flush()
    return out


def parse(pages: DataFrame, html: str = "html", to: str = "items") -> DataFrame:
    """`pages` with `html` replaced by the sequence `to`. Null and empty pages have an empty one."""
    rest = [c for c in pages.columns if c not in (html, to)]
    rows = pages.select(*rest, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = pa.array([items(x.as_py()) for x in part.column(len(rest))], _ITEM_TYPE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*rest, to])

    from pyspark.sql import types as T

    item = T._parse_datatype_string(ITEM)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(to, item)]))


def facts(media: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all
    computed from the stored bytes read back. A null medium has null facts; rows that repeat stay as they
    are, and an empty table gives none."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                stored = data.as_py()
                if stored is None:
                    rows.append((None,) * 6)
                    continue
                back = from_png(stored)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame, key: str, to: str = "items") -> DataFrame:
    """The columns of `sequences` beside `to`, with pos, caption, digest and the columns of `media`, for
    every media reference; null where the reference has no digest or the store no such one. Null sequences
    and those without media give no rows; rows that repeat, on either side, repeat in the result.

    References are many to a digest and may crowd on one. Digests with more than a HOT_SHARE of all
    references, of which there are few by that definition, are spread over SALTS keys on both
    sides. `media` should be light (see `facts`), so that payloads cross the shuffle once, on their
    way into the store.
    """
    new = {to, "pos", "caption", *media.columns}
    rest = [c for c in sequences.columns if c not in new]
    one = sequences.select(*rest, F.explode(to).alias("__item")).where("__item.kind = 'media'")
    refs = written(one.select(*rest, "__item.pos", "__item.caption", "__item.digest"), "refs")
    many = refs.count() // HOT_SHARE
    hot = refs.groupBy("digest").agg(F.count("*").alias("n")).where((F.col("n") > many) & F.col("digest").isNotNull())
    hot = F.broadcast(written(hot.select("digest", F.lit(SALTS).alias("__salts")), "hot"))  # at most HOT_SHARE rows
    salts = F.coalesce("__salts", F.lit(1))
    none = refs.where(F.col("digest").isNull())  # meet nothing, and may be many
    refs = refs.where(F.col("digest").isNotNull()).join(hot, "digest", "left").withColumn("__salt", F.pmod(F.xxhash64(key, "pos"), salts)).drop("__salts")
    rows = media.join(hot, "digest", "left")
    rows = rows.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).drop("__salts")
    return refs.join(rows, ["digest", "__salt"], "left").drop("__salt").unionByName(none, allowMissingColumns=True)


def document_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as interleaved pages (key, n_bytes, html) and their payloads (digest, payload): each
    page has the text as a paragraph, then a figure whose picture holds the text's padded bytes."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), content.alias("t")).withColumn("payload", padded(F.col("t"))).withColumn("digest", F.sha2("payload", 256))
    safe = F.replace(F.replace(F.col("t"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    caption = F.concat(F.lit("bytes of document "), F.coalesce(F.col(key).cast("string"), F.lit("")))
    html = F.concat(F.lit("<p>"), safe, F.lit('</p><figure><img src="digest:'), "digest", F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return rows.select(key, F.octet_length("t").cast("long").alias("n_bytes"), html.alias("html")), rows.select("digest", "payload")
