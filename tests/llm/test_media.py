"""Media columns: pictures as bytes, sequences of pages, and the digest join."""

import hashlib
import math
import os
import time
import zlib

import pytest

from lexspark.llm import media as M


@pytest.mark.parametrize("n", [1, 2, 50])
def test_png_round_trip(n):
    data = os.urandom(M.ROW * n)
    stored = M.to_png(data)
    assert M.from_png(stored) == data and stored[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(ValueError):
        M.from_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


def test_sequences():
    html = (
        "<h1>A &amp; b</h1><p>one <b>two</b><br>three <img src='digest:aa' alt=' al  t '> four</p><script>x<img src='digest:no'></script><!-- <img> -->"
        '<figure><img src="digest:bb"><img src="other"><figcaption>cap <i>x</i></figcaption></figure><p>end'
    )
    got = [(x["pos"], x["kind"], x["text"], x["digest"], x["caption"]) for x in M.items(html)]
    assert got == [
        (0, "text", "A & b", None, None), (1, "text", "one two three", None, None), (2, "media", None, "aa", "al t"), (3, "text", "four", None, None),
        (4, "media", None, "bb", "cap x"), (5, "media", None, None, "cap x"), (6, "text", "end", None, None),
    ]
    assert M.items(None) == M.items("") == [] and M.items("a < b")[0]["text"] == "a < b"


def payload(text):
    data = (text or "").encode()
    return data + b" " * (-len(data) % 192 or (0 if data else 192))


def test_documents(spark):
    texts = [None, "", "x" * 192, "a <b> & c\n", "naïve 😀" * 100, "same", "same", "word " * 100_000] + ["crowd"] * 300
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(5, "same", "z")], "doc_id long, text string, digest string")
    pages, payloads = M.document_pages(df)
    out = M.resolve(M.parse(pages), M.facts(M.store(payloads)), "doc_id").collect()
    assert sorted(r.doc_id for r in out) == sorted([*range(len(texts)), 5])
    seen = {}
    for r in out:
        data = payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() == r.digest and r.tail_crc32 == zlib.crc32(data[-16:])
        assert r.caption == f"bytes of document {r.doc_id}" and r.pos == (1 if (texts[r.doc_id] or "").strip() else 0)
        assert seen.setdefault(texts[r.doc_id] or "", (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_missing_media_and_empty_tables(spark):
    seq = M.parse(spark.createDataFrame([(1, "<img src='digest:zz'>"), (2, None)], "page_id long, html string"))
    none = spark.createDataFrame([], "digest string, payload binary")
    (r,) = M.resolve(seq, M.facts(M.store(none)), "page_id").collect()
    assert (r.page_id, r.digest, r.payload_bytes) == (1, "zz", None)
    assert M.resolve(seq.limit(0), M.facts(M.store(none)), "page_id").collect() == []


def test_null_media_null_digests_and_repeats(spark):
    media = spark.createDataFrame([("aa", M.to_png(b" " * 192)), ("bb", None), (None, None)], "digest string, media binary")
    facts = M.facts(media)
    assert {r.digest: r.payload_bytes for r in facts.collect()} == {"aa": 192, "bb": None, None: None}
    seq = M.parse(spark.createDataFrame([(1, "<img src='digest:aa'><img src='x'>"), (1, "<img src='digest:aa'><img src='x'>"), (2, "<img src='digest:bb'>"), (3, None)], "page_id long, html string"))
    got = sorted((r.page_id, r.pos, r.digest or "", r.payload_bytes or 0) for r in M.resolve(seq, facts, "page_id").collect())
    assert got == [(1, 0, "aa", 192), (1, 0, "aa", 192), (1, 1, "", 0), (1, 1, "", 0), (2, 0, "bb", 0)]


def test_stored_form_by_hand():
    data = bytes(range(192)) + b" " * 192
    stored = M.to_png(data)
    raw = b"".join(b"\0" + data[i : i + 192] for i in (0, 192))
    assert zlib.decompress(stored[stored.index(b"IDAT") + 4 : -16]) == raw
    counts = [data.count(v) for v in range(256)]
    mean = sum(v * n for v, n in enumerate(counts)) / 384
    spread = (sum(n * (v - mean) ** 2 for v, n in enumerate(counts)) / 384) ** 0.5
    bits = -sum(n / 384 * math.log2(n / 384) for n in counts if n)
    assert M.feature(data) == f"mean={mean:.4f};sd={spread:.4f};bits={bits:.4f}"


def test_broken_pages_take_linear_time():
    for broken in ("<p " * 350_000, "<a '" * 250_000, "<!--" * 250_000, "<!" * 500_000):
        start = time.time()
        assert M.items("in" + broken)[0]["text"].startswith("in")
        assert time.time() - start < 20
