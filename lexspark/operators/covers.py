"""Ranking by how close together a question's terms stand: minimal covers over postings with positions.

A cover is a shortest stretch of a chunk that holds all that is asked for. It counts WEIGHT, divided by one more than the
words in it that were not asked for; a chunk's score is the sum over its covers. With `need` any, each
occurrence of a term is a cover, and the score is WEIGHT times the number of occurrences: what `tf` ranks by. With
`need` all, a cover holds every term of the question that the chunk has at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.sizes import bounded, text_bytes
from lexspark.functions.text import terms
from lexspark.operators.indexing import MAX_TF, Analyser

#: What a cover without other words counts.
WEIGHT = 0.1


def positions(chunks: DataFrame, text: str = "content", analyser: Analyser = Analyser(), asked: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(chunk_id, lexeme, positions): where each lexeme stands in its chunk, from 1, the first MAX_TF places. Stop
    words have their places but no rows; several lemmas of a token share its place. With `asked` (qid, lexeme) only
    lexemes of these questions have rows, and nothing else is shuffled."""
    tokens = chunks.select("chunk_id", terms(F.col(text)).alias("t"))
    tokens = tokens if asked is not None else tokens.repartition("chunk_id")
    tokens = tokens.select("chunk_id", F.posexplode("t").alias("at", "lexeme"))
    kept = tokens.where(~F.col("lexeme").isin(*analyser.stop)) if analyser.stop else tokens
    of = analyser.lexemes(kept).select("chunk_id", "lexeme", (F.col("at") + 1).alias("at"))
    if asked is not None:
        wanted = bounded(asked.select("lexeme").distinct(), text_bytes("lexeme"))
        of = of.join(wanted, "lexeme", "left_semi").select("chunk_id", "lexeme", "at").repartition("chunk_id")
    of = of.distinct()
    return of.groupBy("chunk_id", "lexeme").agg(F.slice(F.sort_array(F.collect_list("at")), 1, MAX_TF).alias("positions"))


def _score(hits: Column) -> Column:
    """Sum over the minimal covers of `hits`, an array of (at, term) in order of `at`; terms are numbered from 0 and all
    of them occur. For each hit the last one of each term so far is known; the earliest of these begins the
    shortest stretch that ends here, and it is a cover unless an earlier end began there too."""
    none = F.transform(F.array_distinct(F.transform(hits, lambda h: h["term"])), lambda _: F.lit(-1))
    start = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("begun"), F.lit(0).alias("n"), none.alias("last"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == hit["term"], state["n"]).otherwise(x))
        first = F.array_min(last)
        others = hit["at"] - F.get(hits, first)["at"] - (state["n"] - first)
        new = (first >= 0) & (first > state["begun"])
        more = F.when(new, WEIGHT / (1.0 + F.greatest(others, F.lit(0)))).otherwise(0.0)
        return F.struct((state["score"] + more).alias("score"), F.when(new, first).otherwise(state["begun"]).alias("begun"), (state["n"] + 1).alias("n"), last.alias("last"))

    return F.aggregate(hits, start, step, lambda s: s["score"])


def cover_scores(index: DataFrame, asked: DataFrame, need: str = "all") -> DataFrame:
    """(qid, chunk_id, score) of all chunks with a term of the question; `index` as of `positions`, `asked` (qid, lexeme).
    The postings that a question has in one chunk come together, no more than the chunk has words."""
    met = index.join(bounded(asked, text_bytes("lexeme")), "lexeme")
    if need == "any":
        return met.groupBy("qid", "chunk_id").agg(F.round(WEIGHT * F.sum(F.size("positions")), 6).alias("score"))
    if need != "all":
        raise ValueError(f"unknown need {need!r}")
    found = met.groupBy("qid", "chunk_id").agg(F.sort_array(F.collect_list("positions")).alias("p"))
    hits = F.flatten(F.transform("p", lambda places, term: F.transform(places, lambda at: F.struct(at.alias("at"), term.alias("term")))))
    scored = found.select("qid", "chunk_id", F.sort_array(hits).alias("hits"))
    return scored.select("qid", "chunk_id", F.round(_score(F.col("hits")), 6).alias("score"))


def cover_search(
    chunks: DataFrame, index: DataFrame, questions: DataFrame, limit: int = 25, need: str = "all", include_repealed: bool = False, stop: Sequence[str] = (), lemmas: DataFrame | None = None
) -> DataFrame:
    """(qid, chunk_id, score, rank), the best `limit` for each question; ties go by chunk_id."""
    from lexspark.operators.search import _top, live, query_terms

    return _top(live(cover_scores(index, query_terms(questions, stop=stop, lemmas=lemmas), need), chunks, include_repealed), limit)
