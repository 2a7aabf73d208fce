"""The queries of the training-data operators: thin contracts over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, chat, jaccard, langid, lines, media, mixing, quality, spelling, tokenbin, urls, wrappers
from lexspark.llm.common import new_folder, ship, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Fixed values of op11 and op12: the id that ends a document; of how many runs one loses a letter.
END, MISSPELT = 2, 31
#: The conversation that the contract of op4 adds.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents by source, weights 5, 2, 1 in turn, at most 3 passes over a source."""
    taken = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3.0)
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"] * p["times"])
    return taken.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", words.alias("taken"), "source")


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids, and digests both. Null is the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings (-1); digests what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page by rules, else by the trust and distrust of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures every document and keeps it unless it or its host fails."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as interleaved pages whose pictures hold their bytes; features of the stored bytes."""
    pages, payloads = media.document_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = media.facts(media.store(payloads))
    return media.resolve(media.parse(pages), held, "doc_id").select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        F.col("pos").cast("long").alias("media_pos"),
        "caption",
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 90 % of their 3-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word within 2 edits, or 5 % of their characters, of an earlier one, by document, and what
    is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_duplicate_lines(docs, tau=2, min_words=1, per=20).select(
        "doc_id",
        "n_lines",
        F.size("gone_lines").cast("long").alias("n_gone"),
        "gone_lines",
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids in ranked binary files; digests of what is read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokenbin.export(docs, WORD_BPE, new_folder(spark, "tokens"), end=END)
    return back.select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, of which some lose a letter by a hash, with their variants and roots."""
    runs = spelling.runs(table(spark, sf_dir, "documents"), "doc_id", least=7)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    words = runs.withColumn("h", h).select(
        F.when(F.col("h") % MISSPELT == 0, spelling.without("run", F.col("h") % F.length("run"))).otherwise(F.col("run")).alias("word")
    )
    found = spelling.group_variants(spelling.vocabulary(words, least_length=7, least_n=2), ratio=10)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_mix_sources,
        op2_html_wrappers,
        op3_byte_bpe,
        op4_chat_formatting,
        op5_url_filter,
        op6_quality_rules,
        op7_media_columns,
        op8_ngram_jaccard,
        op9_language_id,
        op10_line_dedup,
        op11_token_ids,
        op12_spelling_variants,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    # Not SQL here: the multinomial mix, wrapper inference, BPE, template rendering, PageRank to a
    # fixed point, PNG bytes, and the other similarity joins; tests hold them against brute force.
    "op6_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, source, text, coalesce({_WORDS}, []) AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) > 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols,
         coalesce(len(l) - len(list_distinct(l)), 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS bad FROM b GROUP BY source),
o AS (SELECT sum(bad) / sum(n) AS mean, sum(n) AS docs, count(*) AS hosts FROM h),
s AS (SELECT any_value(mean) AS mean, sum(n * pow(bad / n - mean, 2)) / any_value(docs)
             - any_value(hosts) * any_value(mean) * (1 - any_value(mean)) / any_value(docs) AS beyond FROM h, o),
p AS (SELECT mean, greatest(2.0, least(1000.0, CASE WHEN beyond > 0 THEN mean * (1 - mean) / beyond - 1 ELSE 1000.0 END)) AS k FROM s),
v AS (SELECT source, (bad + k * mean) / (n + k) > 0.5 AS host_failed FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""",
    # CRC-32 by bytes; near words by what is left at the same place, or by what one has more.
    "op12_spelling_variants": r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7),
met AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (
  SELECT run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END)) AS b FROM met),
hashed AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, tab),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT DISTINCT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
first AS (SELECT word, arg_min(other, r) AS other FROM (
    SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near) GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN first.other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word) USING (word)
""",
}
