"""Checks of parsed acts, chunks, gold questions and indexes. Each gives rows; `assert_none` makes
rows an error."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X

# Fixed values of the checks.
HOLLOW_CHARS, SUBSTANTIAL_CHARS, NAMED = 20, 120, 10
EXPECTED = {"kp": (430, 530)}
ANY_COUNT = (1, 10_000)


class ValidationError(RuntimeError):
    """A structural check failed."""


def shape(articles: DataFrame) -> DataFrame:
    """Report by act: counts of articles, repealed, superscripted, paragraphs, first and last."""
    return articles.groupBy("act").agg(
        F.count("*").alias("articles"),
        F.count_if("repealed").alias("repealed"),
        F.count_if(F.contains("article", F.lit("^"))).alias("superscripted"),
        F.sum(F.size("paragraphs")).alias("paragraphs"),
        F.min_by("article", "segment").alias("first"),
        F.max_by("article", "segment").alias("last"),
    )


def duplicate_ids(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(rows: DataFrame, by: str, position: str, value: Column) -> DataFrame:
    """Rows whose value is below that of the row before: (by, position, previous, value)."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(position))
    found = rows.select(by, position, before.alias("previous"), value.alias("value"))
    return found.where("value < previous")


def statutory_order(articles: DataFrame) -> DataFrame:
    """Articles that stand before a smaller one: (act, segment, previous, value) with sort keys."""
    return out_of_order(articles, "act", "segment", X.sort_key(F.col("article")))


def outside_band(
    articles: DataFrame, bands: Mapping[str, tuple[int, int]] = EXPECTED, default: tuple[int, int] = ANY_COUNT
) -> DataFrame:
    """Acts whose number of articles is out of the expected band; `default` is that of other acts."""
    table = F.create_map(*[x for act, (low, high) in bands.items() for x in (F.lit(act), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))])
    band = F.coalesce(table[F.col("act")], F.struct(F.lit(default[0]).alias("low"), F.lit(default[1]).alias("high")))
    counts = articles.groupBy("act").agg(F.count("*").alias("n")).withColumn("band", band)
    return counts.where(~F.col("n").between(F.col("band.low"), F.col("band.high"))).select("act", "n", "band.low", "band.high")


def unplaced(articles: DataFrame) -> DataFrame:
    return articles.where(F.size("title_path") == 0)


def hollow(rows: DataFrame, text: str = "text", least: int = HOLLOW_CHARS) -> DataFrame:
    """In force, but next to no text."""
    return rows.where(~F.col("repealed") & (F.length(text) < least))


def substantial(rows: DataFrame, text: str = "text", most: int = SUBSTANTIAL_CHARS) -> DataFrame:
    """Not in force, but with a text that looks alive."""
    return rows.where(F.col("repealed") & (F.length(text) > most))


def swallowed(rows: DataFrame, text: str = "text") -> DataFrame:
    """Bodies that contain another article's heading, with that heading."""
    return rows.withColumn("heading", F.regexp_extract(text, X.EMBEDDED_HEADING, 0)).where("heading <> ''")


def problems(articles: DataFrame, bands: Mapping[str, tuple[int, int]] = EXPECTED) -> DataFrame:
    """(act, problem, n, named): every failed check of parsed acts, the first NAMED articles named."""
    name = F.col("article_display")
    found = [
        duplicate_ids(articles, "act", "article").select("act", F.lit("duplicate ids").alias("problem"), F.col("article").alias("name")),
        statutory_order(articles).select("act", F.lit("out of order"), F.col("segment").cast("string")),
        outside_band(articles, bands).select("act", F.lit("count outside band"), F.col("n").cast("string")),
        unplaced(articles).select("act", F.lit("no structural path"), name),
        hollow(articles).select("act", F.lit("little text"), name),
        substantial(articles).select("act", F.lit("not in force with text"), name),
        swallowed(articles).select("act", F.lit("swallowed heading"), F.concat_ws(": ", name, F.col("heading"))),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    place = F.row_number().over(Window.partitionBy("act", "problem").orderBy("name"))
    every = every.withColumn("place", place)
    return every.groupBy("act", "problem").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= NAMED, F.col("name")))).alias("named")
    )


def validate(articles: DataFrame, bands: Mapping[str, tuple[int, int]] = EXPECTED) -> DataFrame:
    """`shape(articles)`, or an error with all problems. No articles are a problem."""
    if not articles.limit(1).count():
        raise ValidationError("parsed zero articles")
    failed = problems(articles, bands).limit(100).collect()
    if failed:
        raise ValidationError("; ".join(f"{r.act}: {r.problem} {r.n} {r.named}" for r in failed))
    return shape(articles)


def wrong_width(rows: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Embedded rows whose vector has another width than declared."""
    return rows.where(F.col(embedding).isNotNull() & (F.size(embedding) != dim))


def unpaired(chunks: DataFrame, vectors: DataFrame, key: str | list[str]) -> DataFrame:
    """(chunks, vectors, missing): counts, and chunks without a vector."""
    missing = chunks.join(vectors.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(vectors.agg(F.count("*").alias("vectors"))).crossJoin(missing)


def require_analyser(lemmas: DataFrame) -> DataFrame:
    """`lemmas`, or an error if the table lacks a column that the analyser needs."""
    lacking = {"token", "lemma"} - set(lemmas.columns)
    if lacking:
        raise ValidationError(f"the analyser's table has no {', '.join(sorted(lacking))}")
    return lemmas


def gold_problems(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(problem, qid, article): duplicate question ids, acts without chunks, cited articles that the
    corpus lacks, repealed ones cited without `repealed` in the notes. An empty set is a problem too."""
    known = chunks.groupBy("act", "article").agg(F.bool_and("repealed").alias("repealed"))
    cited = gold.select("qid", "act", "notes", F.explode("ground_truth_articles").alias("article"))
    none = F.lit(None).cast("string")
    twice = duplicate_ids(gold, "qid").select(F.lit("duplicate id").alias("problem"), F.col("qid").cast("string").alias("qid"), none.alias("article"))
    acts = chunks.select("act").distinct()
    no_act = gold.join(acts, "act", "left_anti").select(F.lit("act without chunks"), F.col("qid").cast("string"), F.col("act"))
    missing = cited.join(known, ["act", "article"], "left_anti").join(acts, "act", "left_semi")
    missing = missing.select(F.lit("not in the corpus"), F.col("qid").cast("string"), "article")
    dead = cited.join(known.where("repealed"), ["act", "article"]).where(~F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit("repealed")))
    dead = dead.select(F.lit("repealed without a note"), F.col("qid").cast("string"), "article")
    empty = gold.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty set"), none, none)
    return twice.union(no_act).union(missing).union(dead).union(empty)


def gold_report(gold: DataFrame) -> DataFrame:
    """(topic, n, single, multi, unsourced, thin): what the gold set covers."""
    single = F.size("ground_truth_articles") == 1
    return gold.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.count_if(single).alias("single"),
        F.count_if(~single).alias("multi"),
        F.count_if(F.coalesce("source_url", F.lit("")) == "").alias("unsourced"),
        (F.count("*") < 2).alias("thin"),
    )


def constraint_problems(gold: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Gold rows that break a constraint: question under 10 characters, no article, unknown topic."""
    bad = (F.length("question") < 10) | (F.size("ground_truth_articles") < 1)
    return gold.where(bad | ~F.col("topic").isin(*topics) if topics else bad)


def run_problems(runs: DataFrame) -> DataFrame:
    """(run, problem) of metrics runs (context, metrics) that break a constraint: an unknown layer, a number out
    of its range, or one that its layer requires and is not there."""
    layer = F.col("metrics.layer")
    share = lambda c: c.isNotNull() & ~c.between(0.0, 1.0)
    need = lambda kind, c: (layer == kind) & c.isNull()
    m = lambda name: F.col(f"metrics.`{name}`")
    checks = {"layer": layer.isNull() | ~layer.isin("retrieval", "audit")}
    for name in ("api_cost_usd", "duration_s"):
        checks[name] = F.col(f"context.{name}").isNull() | (F.col(f"context.{name}") < 0)
    for kind, counted, least in (("retrieval", "n_questions", 1), ("audit", "n_contracts", 1), ("audit", "n_planted_violations", 0)):
        checks[counted] = need(kind, m(counted)) | (m(counted) < least)
    checks["recall_at_k"] = need("retrieval", m("recall_at_k"))
    for name in ("mrr", "faithfulness"):
        checks[name] = share(m(name))
    for name in ("precision", "recall", "f1"):
        checks[name] = need("audit", m(name)) | share(m(name))
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items())))
    return runs.select(F.col("context.timestamp").alias("run"), F.explode(found).alias("problem"))


def table_problems(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(problem, n): constraints that rows of a chunk table break: a null where the table declares none, an index or a count
    below 0, a key that several rows have."""
    bare = {f"{c} is null": F.col(c).isNull() for c in (*key, "content", "repealed") if c in chunks.columns}
    least = {f"{c} below 0": F.col(c) < 0 for c in ("part_index", "n_tokens") if c in chunks.columns}
    checks = bare | least
    sums = chunks.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    found = sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("problem"), F.col(f"`{name}`").alias("n")) for name in checks])))
    twice = duplicate_ids(chunks, *key).agg(F.count("*").alias("n")).select(F.lit("key of several rows").alias("problem"), "n")
    return found.union(twice).where("n > 0")


def require_constraints(chunks: DataFrame, key: list[str]) -> None:
    """An error that names every constraint which the table breaks."""
    if found := table_problems(chunks, key).collect():  # one row a constraint
        raise ValidationError("; ".join(f"{r.problem}: {r.n}" for r in found))


def known_articles(chunks: DataFrame, act: str | None = None) -> DataFrame:
    rows = chunks if act is None else chunks.where(F.col("act") == act)
    return rows.select("act", "article", "repealed").distinct()


def assert_none(found: DataFrame, what: str) -> None:
    rows = found.limit(NAMED).collect()
    if rows:
        raise ValidationError(f"{what}: {rows}")
