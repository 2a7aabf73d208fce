"""From page texts to articles with paragraphs and a place in the act's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X

_CUT = "\x1e"


def line_stream(pages: DataFrame) -> DataFrame:
    """(act, page, at, line): the lines of all pages, trimmed, blank ones left out."""
    rows = pages.select("act", F.col("number").alias("page"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.withColumn("line", X.strip(F.col("line"))).where("line <> ''")


def marked_lines(pages: DataFrame) -> DataFrame:
    """Lines with level (of a structural heading, else null), is_article, and is_title: the line after a
    heading that is neither a heading nor an article belongs to that heading."""
    rows = line_stream(pages)
    word = F.lower(F.regexp_extract("line", X.HEADING, 1))
    level = F.when(word == X.LEVELS[0], 0).when(word == X.LEVELS[1], 1).when(word == X.LEVELS[2], 2)
    order = Window.partitionBy("act").orderBy("page", "at")
    rows = rows.withColumns({"level": level, "is_article": F.col("line").rlike(X.ARTICLE) & level.isNull()})
    after = F.lag(F.col("level").isNotNull(), 1, False).over(order)
    return rows.withColumn("is_title", after & F.col("level").isNull() & ~F.col("is_article"))


def titled_lines(pages: DataFrame) -> DataFrame:
    """Marked lines with title_path: for each level the last heading so far with its title, if no
    heading of a higher level has come since."""
    order = Window.partitionBy("act").orderBy("page", "at")
    rows = marked_lines(pages).withColumn("next", F.when(F.lead("is_title").over(order), F.lead("line").over(order)))
    label = F.when(F.col("next").isNotNull(), F.concat_ws(" — ", "line", "next")).otherwise(F.col("line"))
    place = F.struct("page", "at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in range(3):
        here = F.when(F.col("level") == n, F.struct(place.alias("place"), label.alias("label")))
        rows = rows.withColumn(f"h{n}", F.last(here, True).over(so_far))
    for n in (1, 2):
        for up in range(n):
            newer = F.col(f"h{up}.place") > F.col(f"h{n}.place")
            rows = rows.withColumn(f"h{n}", F.when(F.coalesce(newer, F.lit(False)), F.lit(None)).otherwise(F.col(f"h{n}")))
    path = F.array_compact(F.array(*[F.col(f"h{n}.label") for n in range(3)]))
    return rows.withColumn("title_path", path).drop("h0", "h1", "h2", "next")


def segments(pages: DataFrame) -> DataFrame:
    """One row an article heading: act, segment, bracket, raw id, page_start, title_path, body (lines
    joined by a space). Lines before the first article, headings and their titles are in none."""
    order = Window.partitionBy("act").orderBy("page", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = titled_lines(pages).withColumn("segment", F.sum(F.col("is_article").cast("long")).over(order))
    rows = rows.where("segment > 0 and level is null and not is_title")
    text = F.when(F.col("is_article"), F.regexp_replace("line", X.ARTICLE, "")).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct("page", "at", text.alias("text"))))
    first = F.min_by(F.struct("line", "page", "title_path"), F.struct("page", "at"))
    rows = rows.groupBy("act", "segment").agg(parts.alias("parts"), first.alias("head"))
    return rows.select(
        "act",
        "segment",
        F.regexp_extract("head.line", X.ARTICLE, 1).alias("bracket"),
        X.clean_id(F.regexp_extract("head.line", X.ARTICLE, 2)).alias("article"),
        F.col("head.page").alias("page_start"),
        "head.title_path",
        X.strip_brackets(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text"),
    )


def paragraphs(body: Column) -> Column:
    """Array of (marker, text, repealed): the body cut at its § markers. Without a marker the body is
    one unmarked paragraph; text before the first marker and empty paragraphs are dropped."""
    none = F.array(F.struct(F.lit("").alias("marker"), X.strip(body).alias("text")))

    def pairs(parts: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(2)),
            lambda i: F.struct(F.get(parts, i).alias("marker"), X.strip(F.get(parts, i + 1)).alias("text")),
        )
        return F.when(F.size(parts) >= 3, each).otherwise(none)

    found = X.let(F.split(F.regexp_replace(body, X.MARKER, f"{_CUT}$1{_CUT}"), _CUT), pairs)
    return F.transform(
        F.filter(found, lambda p: p["text"] != ""),
        lambda p: F.struct(p["marker"].alias("marker"), p["text"].alias("text"), (X.repeal_kind(p["text"]) != "").alias("repealed")),
    )


def articles(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles in force today, and those skipped because they are law of a future date.

    An article is not in force only if its whole body says so. Segmentation orders the lines of one
    act, so acts are parsed in parallel and an act is the unit of a task.
    """
    rows = segments(pages)
    kind = X.repeal_kind(F.col("text"))
    now = rows.where("bracket <> '<'").select(
        "act",
        "segment",
        "article",
        X.to_display(F.col("article")).alias("article_display"),
        "title_path",
        paragraphs(F.col("text")).alias("paragraphs"),
        (kind != "").alias("repealed"),
        kind.alias("repeal_kind"),
        "page_start",
        "text",
    )
    return now, rows.where("bracket = '<'").select("act", "segment", "article", "page_start", "text")
