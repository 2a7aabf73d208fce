"""Answering questions in batches: rewrite, retrieve, grade, answer or refuse, verify."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.shared import written
from lexspark.functions.text import citation, terms
from lexspark.operators.models import Model, called, usage_rows

MAX_PASSAGES = 6
# Texts that results carry.
REFUSAL_REASON = "structured output failed"
REPEALED_MARK = " [PRZEPIS UCHYLONY]"
#: Where the caller gives no texts of its own.
DISCLAIMER = "To nie jest porada prawna: odpowiedź złożył program z przepisów, które znalazł, i może on się mylić."
REFUSAL = "Nie znalazłem przepisu, na którym mogłaby się oprzeć odpowiedź na to pytanie."


@dataclass(frozen=True)
class Models:
    """The places where models plug in, as columns. The defaults are deterministic: the question as it
    is, relevance by shared terms, and the first passage's citation as the answer."""

    rewrite: Callable[[Column], Column] = lambda question: question
    relevant: Callable[[Column, Column], Column] = lambda question, content: F.size(F.array_intersect(terms(question), terms(content))) >= 3
    reason: Callable[[Column, Column], Column] = lambda question, content: F.lit("fewer than 3 shared terms")
    answer: Callable[[Column, Column], Column] = lambda question, passages: F.when(F.size(passages) > 0, passages[0])
    cited: Callable[[Column], Column] = lambda graded: F.transform(graded, lambda h: F.struct(h["act"].alias("act"), h["article"].alias("article")))


#: What models are told, when they are called (see `answered_by`).
REWRITE = "Zapisz pytanie tak, jak ująłby je przepis prawa pracy. Zostaw liczby i terminy. Podaj pole query, bez odpowiedzi na pytanie."
GRADE = "Oceń, czy sam ten przepis jest potrzebny do odpowiedzi na pytanie. Podaj pola relevant (true lub false) i reason."
ANSWER = "Odpowiedz krótko po polsku, tylko z podanych przepisów; uchylone nie są podstawą odpowiedzi. Podaj pola answer i citations (act, article)."


def understand(questions: DataFrame, models: Models = Models()) -> DataFrame:  # noqa: B008
    """search_query: the rewritten question, or the question where the rewrite is null or blank."""
    made = F.nullif(F.trim(models.rewrite(F.col("question"))), F.lit(""))
    return questions.withColumn("search_query", F.coalesce(made, F.col("question")))


def passage(hit: Column) -> Column:
    """A hit as the answering model sees it: citation, path, a mark if repealed, content."""
    path = F.when(F.size(hit["title_path"]) > 0, F.concat(F.lit(" ["), F.array_join(hit["title_path"], " > "), F.lit("]"))).otherwise("")
    return F.concat(citation(hit["article_display"], hit["paragraph"]), path, F.when(hit["repealed"], REPEALED_MARK).otherwise(""), F.lit("\n"), hit["content"])


def prompt(**parts: Column) -> Column:
    """Named parts, each below its name, in order; null ones are left out."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{name.upper()}\n"), part) for name, part in parts.items()))


def grade(hits: DataFrame, models: Models = Models()) -> DataFrame:  # noqa: B008
    """Hits (qid, question, rank, ...) with relevant and reason; a null verdict is in neither output."""
    return hits.withColumn("relevant", models.relevant(F.col("question"), F.col("content"))).withColumn(
        "reason", models.reason(F.col("question"), F.col("content"))
    )


def kept(graded: DataFrame, most: int = MAX_PASSAGES) -> DataFrame:
    """The first `most` relevant hits of each question, in the order of the ranking."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return graded.where("relevant").withColumn("place", place).where(F.col("place") <= most)


def rejected(graded: DataFrame) -> DataFrame:
    return graded.where("not relevant").select("qid", "rank", "act", "article", "reason")


def route(questions: DataFrame, graded: DataFrame) -> DataFrame:
    """(qid, n_graded, route): answer if a hit was kept, else refuse."""
    n = kept(graded).groupBy("qid").agg(F.count("*").alias("n"))
    return questions.select("qid").join(n, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("n_graded"), F.when(F.col("n") > 0, "answer").otherwise("refuse").alias("route")
    )


def verify_citations(cited: DataFrame, graded: DataFrame) -> DataFrame:
    """`cited` (qid, act, article) with supported: whether that article was among the kept hits."""
    seen = graded.select("qid", "act", "article").distinct().withColumn("s", F.lit(True))
    return cited.join(seen, ["qid", "act", "article"], "left").select(*cited.columns, F.coalesce("s", F.lit(False)).alias("supported"))


def ask(questions: DataFrame, hits: DataFrame, models: Models = Models(), shown: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """One row a question: question, answer, refused, refusal_reason, considered, grounded_in,
    citations, unsupported_citations, rejected.

    `hits` are the merged results for `search_query` with their content. Unsupported citations are
    taken out and listed; an answer of which none is supported still is one. A question of which no
    hit is kept, or for which the answering model gives nothing, is refused.
    """
    rows = gathered(questions, grade(hits.join(questions.select("qid", "question"), "qid"), models))
    answer = F.when(F.size("graded") > 0, models.answer(F.col("question"), F.transform("graded", passage)))
    return finished(rows.withColumn("answer", answer).withColumn("cited", models.cited(F.col("graded"))), shown)


def gathered(questions: DataFrame, graded: DataFrame) -> DataFrame:
    """`questions` with graded (the kept hits in order, as structs; empty if none), considered and rejected."""
    hit = F.struct("rank", "act", "article", "article_display", "paragraph", "title_path", "repealed", "content")
    used = kept(graded).groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("graded"))
    seen = graded.groupBy("qid").agg(
        F.count("*").alias("considered"), F.array_sort(F.collect_list(F.when(~F.col("relevant"), F.struct("rank", "article", "reason")))).alias("rejected")
    )
    none = F.array().cast(used.schema["graded"].dataType)
    return questions.join(used, "qid", "left").join(seen, "qid", "left").withColumn("graded", F.coalesce("graded", none))


def finished(rows: DataFrame, shown: Sequence[str] = ()) -> DataFrame:
    """The results of `ask`, of gathered rows with answer and cited."""
    there = F.transform("graded", lambda h: F.struct(h["act"].alias("act"), h["article"].alias("article")))
    good, bad = F.array_intersect("cited", there), F.array_except("cited", there)
    refused = F.col("answer").isNull()
    reason = F.when(F.size("graded") == 0, "no relevant passage").when(refused, REFUSAL_REASON)
    empty = F.array().cast("array<struct<act:string,article:string>>")
    return rows.select(
        "qid",
        "question",
        "answer",
        refused.alias("refused"),
        reason.alias("refusal_reason"),
        F.coalesce("considered", F.lit(0)).alias("considered"),
        F.transform("graded", lambda h: citation(h["article_display"], h["paragraph"])).alias("grounded_in"),
        F.when(refused, empty).otherwise(good).alias("citations"),
        F.when(refused, empty).otherwise(bad).alias("unsupported_citations"),
        "rejected",
        *shown,
    )


def rewritten_by(questions: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(`questions` with search_query, usage): the model's phrase, or the question where it gave none."""
    done = written(called(questions, prompt(pytanie=F.col("question")), model, REWRITE, "query string", "call"), "rewritten")
    phrase = F.nullif(F.trim(F.col("call.parsed.query")), F.lit(""))
    return done.withColumn("search_query", F.coalesce(phrase, "question")).drop("call"), usage_rows(done, "call")


def answered_by(questions: DataFrame, hits: DataFrame, cheap: Model, strong: Model, shown: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(results as of `ask`, usage (qid, model, input_tokens, output_tokens)). The cheap model grades each hit for
    itself, one without a verdict counts for nothing; the strong one answers from the kept hits, and
    where it gives no answer in the form asked for, the question is refused. Each call is made once."""
    hit = hits.join(questions.select("qid", "question"), "qid")
    place = F.concat_ws(" ", citation(F.col("article_display"), F.col("paragraph")), F.array_join("title_path", " > "))
    asked = prompt(pytanie=F.col("question"), przepis=F.concat_ws("\n", place, F.col("content")))
    graded = written(called(hit, asked, cheap, GRADE, "relevant boolean, reason string", "call"), "graded")
    verdicts = graded.withColumns({"relevant": F.col("call.parsed.relevant"), "reason": F.col("call.parsed.reason")}).drop("call")
    rows = written(gathered(questions, verdicts), "gathered")
    asked = prompt(pytanie=F.col("question"), przepisy=F.array_join(F.transform("graded", passage), "\n\n"))
    some = rows.where(F.size("graded") > 0).select("qid", asked.alias("asked"))
    replies = written(called(some, F.col("asked"), strong, ANSWER, "answer string, citations array<struct<act:string,article:string>>", "call"), "answered")
    answers = replies.select("qid", F.nullif(F.trim(F.col("call.parsed.answer")), F.lit("")).alias("answer"), F.col("call.parsed.citations").alias("cited"))
    empty = F.array().cast("array<struct<act:string,article:string>>")
    done = rows.join(answers, "qid", "left").withColumn("cited", F.coalesce("cited", empty))
    return finished(done, shown), usage_rows(graded, "call").union(usage_rows(replies, "call"))
