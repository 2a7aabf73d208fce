"""The engine's verbs over a loaded table: build, search, ask, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.settings import Settings
from lexspark.functions.shared import written
from lexspark.operators import chunking, evaluation, indexing, loading, parsing, qa, search, validation
from lexspark.operators.indexing import read_frequencies, read_index, read_postings
from lexspark.operators.models import Model
from lexspark.operators.vectors import approximate_search, read_vectors
from lexspark.sources import files
from lexspark.sources.acquire import fetch

LEAST_QUESTION, LONGEST_QUESTION = 3, 1000


class Invalid(ValueError):
    """A request outside its bounds."""


def health(spark: SparkSession, path: str) -> dict:
    """The current version and its counts."""
    version = loading.current_version(spark, path)
    return {"version": version} | loading.load_stats(spark.read.parquet(f"{path}/{version}/chunks")).first().asDict()


def build(pages: DataFrame, bands=validation.EXPECTED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parse, validate and chunk page texts: (report, chunks, skipped future articles)."""
    now, future = parsing.articles(pages)
    return validation.validate(now, bands), chunking.chunks(now), future


def _corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    version = loading.current_version(spark, path)
    chunks = spark.read.parquet(f"{path}/{version}/chunks").withColumnRenamed("id", "chunk_id")
    return chunks, read_postings(spark, path, version), read_index(spark, path, version)[1]


def find(spark: SparkSession, path: str, questions: DataFrame, encoder: loading.Encoder, settings: Settings = Settings(), leg: str = "hybrid", k: int | None = None, analyser: indexing.Analyser = indexing.POLISH, include_repealed: bool = False) -> DataFrame:  # noqa: B008
    """Hits of each question (qid, question[, search_query]) with both ranks and what a result shows. The
    analyser is the one that the table was loaded with. With `vector_probes` in the settings the dense leg looks at so
    many cells of the vector index, which the table then has to be loaded with; else it is exact."""
    chunks, index, stats = _corpus(spark, path)
    version = loading.current_version(spark, path)
    near = None
    if settings.vector_probes:
        cells = read_vectors(spark, f"{path}/{version}")
        near = lambda given, limit: approximate_search(*cells, given, settings.vector_probes, limit, include_repealed)
    asked = questions.select("qid", F.coalesce("search_query", "question").alias("question")) if "search_query" in questions.columns else questions
    vectors = loading.encode_queries(asked, encoder).select("qid", "vector")
    ranked = search.search(
        chunks, index, stats, asked, vectors, leg, k or settings.retrieval_top_k,
        ranking=settings.lexical_ranking, k1=settings.bm25_k1, b=settings.bm25_b, fusion=settings.fusion, alpha=settings.hybrid_alpha, stop=analyser.stop, lemmas=analyser.lemmas,
        near=near, include_repealed=include_repealed, frequencies=read_frequencies(spark, path, version),
    )
    return search.hits(ranked, chunks)


def ask(spark: SparkSession, path: str, questions: DataFrame, encoder: loading.Encoder, models: qa.Models = qa.Models(), settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Answers or refusals of a batch of questions. A question out of bounds makes the batch invalid."""
    require_bounds(questions)
    rows = qa.understand(questions, models)
    return qa.ask(rows, find(spark, path, rows, encoder, settings), models, shown=["search_query"])


def require_bounds(questions: DataFrame) -> None:
    bad = questions.where(~F.length("question").between(LEAST_QUESTION, LONGEST_QUESTION)).limit(5).collect()
    if bad:
        raise Invalid(f"questions must have {LEAST_QUESTION} to {LONGEST_QUESTION} characters: {[r.qid for r in bad]}")


def ask_models(spark: SparkSession, path: str, questions: DataFrame, encoder: loading.Encoder, cheap: Model, strong: Model, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(results as of `ask`, usage (qid, model, input_tokens, output_tokens)) with models called in batches."""
    require_bounds(questions)
    rows, first = qa.rewritten_by(questions, cheap)
    answers, more = qa.answered_by(rows, find(spark, path, rows, encoder, settings), cheap, strong, shown=["search_query"])
    return answers, first.union(more)


def responses(answers: DataFrame, usage: DataFrame, prices: DataFrame, refusal: str = qa.REFUSAL, disclaimer: str = qa.DISCLAIMER) -> DataFrame:
    """(qid, response): what a caller gets, as JSON: the answer or the text of `refusal`, what it rests on, the
    disclaimer and what it cost."""
    costs = evaluation.usage(usage, prices, ("qid", "model")).groupBy("qid").agg(F.sum("cost_usd").alias("cost_usd"))
    rows = answers.join(costs, "qid", "left")
    fields = [
        F.when(F.col("refused"), F.lit(refusal)).otherwise(F.col("answer")).alias("answer"),
        "citations",
        "refused",
        "refusal_reason",
        "search_query",
        "considered",
        F.size("grounded_in").alias("grounded_in"),
        F.lit(disclaimer).alias("disclaimer"),
        F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"),
    ]
    return rows.select("qid", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("response"))


def evaluate(spark: SparkSession, path: str, gold: DataFrame, encoder: loading.Encoder, settings: Settings = Settings(), leg: str = "hybrid") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(scores, missed at 5) of gold questions (id, question, act, ground_truth_articles)."""
    asked = gold.select(F.col("id").alias("qid"), "question")
    truth = gold.select(F.col("id").alias("qid"), "act", F.explode("ground_truth_articles").alias("article"))
    chunks, _, _ = _corpus(spark, path)
    ranked = find(spark, path, asked, encoder, settings, leg, settings.bm25_candidates + settings.vector_candidates)
    rows = evaluation.per_question(truth, search.collapse_to_articles(ranked.select("qid", "chunk_id", "rank"), chunks))
    rows = written(rows, "evaluated")
    return evaluation.scores(rows), evaluation.missed(rows)


def manifest_report(acts: DataFrame, folder: str, repin: bool = False) -> DataFrame:
    """Status of each act's file against its pin."""
    return files.verify_or_pin(acts, files.fetched(acts.sparkSession, folder), repin).select("slug", "eli", "variant", "status", "bytes", "sha256")


def fetch_all(acts: DataFrame, folder: str, repin: bool = False, timeout: float = 60.0, tries: int = 3) -> DataFrame:
    """Fetches the file of every act that the table in `folder` lacks (or, to pin anew, of all), and reports the
    status of each; files that cannot be fetched, or differ from their pin, are an error. The executors fetch and
    write the files (`files.read_kept` has them); `folder` is a path that they share."""
    kept = files.read_kept(acts.sparkSession, folder).select("file_name", "bytes", "digest")
    wanted = acts.select("file_name", "url").distinct()
    if not repin:
        wanted = wanted.join(kept, "file_name", "left_anti")
    if wanted.limit(1).count():
        failed = files.append_fetched(fetch(wanted, tries, timeout), folder).limit(10).collect()
        if failed:
            raise OSError(f"not fetched: {[(r.url, r.error) for r in failed]}")
        kept = files.read_kept(acts.sparkSession, folder).select("file_name", "bytes", "digest")
    checked = files.require_verified(files.verify_or_pin(acts, kept, repin))
    return checked.select("slug", "eli", "variant", "status", "bytes", "sha256")
