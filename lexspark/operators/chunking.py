"""From articles to chunks that fit the encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X

MODEL_MAX_TOKENS, TOKEN_BUDGET, LEAST_BUDGET = 512, 480, 64
Counter = Callable[[Column], Column]


def pack(sizes: Column, budget: Column) -> Column:
    """Group number of each of an array of sizes: pieces are taken in order while their sum fits the
    budget; a piece larger than it stands alone."""
    start = F.struct(F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, n: Column) -> Column:
        full = (state["used"] > 0) & (state["used"] + n > budget)
        group = state["group"] + F.when(full, 1).otherwise(0)
        used = F.when(full, n).otherwise(state["used"] + n)
        return F.struct(group.cast("long").alias("group"), used.cast("long").alias("used"), F.array_append(state["out"], group.cast("long")).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def grouped(pieces: Column, count: Counter, budget: Column) -> Column:
    """Array of arrays: `pieces` (structs with text) packed by `count`."""
    sizes = F.transform(pieces, lambda p: count(p["text"]).cast("long"))
    of = lambda groups: F.transform(F.array_distinct(groups), lambda g: F.filter(pieces, lambda p, i: F.get(groups, i) == g))
    return X.let(pack(sizes, budget), of)


def split_oversized(text: Column, count: Counter, budget: Column) -> Column:
    """Array of texts: `text` if it fits, else its sentences (parted after . ; or :) packed in order; a
    sentence over the budget stays whole."""
    sentences = F.transform(F.split(text, X.SENTENCE_END), lambda s: F.struct(s.alias("text")))
    groups = X.let(sentences, lambda pieces: grouped(pieces, count, budget))
    joined = F.transform(groups, lambda g: F.array_join(F.transform(g, lambda s: s["text"]), " "))
    return F.when(count(text) <= budget, F.array(text)).otherwise(joined)


def _joined(pieces: Column) -> Column:
    one = lambda p: F.when(p["marker"] != "", F.concat(F.lit("§ "), p["marker"], F.lit(". "), p["text"])).otherwise(p["text"])
    return F.array_join(F.transform(pieces, one), " ")


def chunks(articles: DataFrame, count: Counter = X.n_words, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row a chunk: an article that fits is one; else its paragraphs are packed, and a paragraph
    over the budget is parted at sentences. The budget is what the encoder's prefix, the path and
    the widest citation header leave, at least LEAST_BUDGET. part_index is dense by article.
    """
    struct = lambda m, t: F.struct(m.alias("marker"), t.alias("text"))
    rows = articles.withColumn("pieces", F.transform("paragraphs", lambda p: struct(p["marker"], p["text"])))
    markers = F.transform("pieces", lambda p: p["marker"])
    widest = F.aggregate(markers, F.lit(""), lambda a, m: F.when(F.length(m) > F.length(a), m).otherwise(a))
    header = lambda m: X.citation(F.col("article_display"), m)
    overhead = count(X.embedding_input(F.col("title_path"), F.concat(header(widest), F.lit("."))))
    rows = rows.withColumn("left", F.greatest(F.lit(budget) - overhead, F.lit(LEAST_BUDGET)).cast("long"))
    left = F.col("left")

    def parts(group: Column) -> Column:
        alone = F.transform(split_oversized(group[0]["text"], count, left), lambda t: struct(group[0]["marker"], t))
        return F.when(F.size(group) == 1, alone).otherwise(F.array(struct(F.lit(""), _joined(group))))

    def cut(pieces: Column, whole: Column) -> Column:
        single = F.size(pieces) == 1
        first = F.get(pieces, F.lit(0))
        one = F.array(struct(F.when(single, first["marker"]).otherwise(F.lit("")), F.when(single, first["text"]).otherwise(whole)))
        many = F.flatten(F.transform(grouped(pieces, count, left), parts))
        return F.when(count(whole) <= left, one).otherwise(many)

    empty = F.array(struct(F.lit(""), F.col("text")))
    made = X.let(F.col("pieces"), lambda pieces: X.let(_joined(pieces), lambda whole: cut(pieces, whole)))
    body = F.when(F.size("pieces") == 0, empty).otherwise(made)
    rows = rows.select("*", F.posexplode(body).alias("part_index", "part"))
    content = F.trim(F.concat(header(F.col("part.marker")), F.lit(". "), F.col("part.text")))
    return rows.select(
        "act",
        "article",
        "article_display",
        F.col("part.marker").alias("paragraph"),
        "part_index",
        "title_path",
        "page_start",
        "repealed",
        "repeal_kind",
        content.alias("content"),
        count(content).cast("long").alias("n_tokens"),
    )


def packed_rows(pieces: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """(by, part_index, n_pieces, n_tokens): greedy packing of rows (by, order, size)."""
    rows = pieces.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n")))).alias("p"))
    sizes = F.transform("p", lambda x: x["n"])
    rows = rows.select(by, F.arrays_zip(pack(sizes, F.lit(budget)).alias("g"), sizes.alias("n")).alias("z")).select(by, F.explode("z").alias("z"))
    return rows.groupBy(by, F.col("z.g").alias("part_index")).agg(F.count("*").alias("n_pieces"), F.sum("z.n").alias("n_tokens"))


def renumbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`rows` with part_index dense from 0 within `by`."""
    return rows.withColumn("part_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def over_limit(made: DataFrame, count: Counter = X.n_words, limit: int = MODEL_MAX_TOKENS) -> DataFrame:
    """Chunks whose encoder input the model would cut off."""
    return made.where(count(X.embedding_input(F.col("title_path"), F.col("content"))) > limit)


def within_limit(made: DataFrame, count: Counter = X.n_words, limit: int = MODEL_MAX_TOKENS) -> DataFrame:
    """`made`, or an error that names the first five chunks over the limit."""
    bad = over_limit(made, count, limit).select("article", "paragraph", "part_index").limit(5).collect()
    if bad:
        named = ", ".join(f"{r.article} § {r.paragraph} [{r.part_index}]" for r in bad)
        raise ValueError(f"chunks over {limit} tokens: {named}")
    return made
