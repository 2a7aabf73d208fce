"""The jobs as queries: each runs twice into one new folder of spark.checkpoint.dir and is read back from there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import incremental_index, ranking_study
from lexspark.functions.shared import shared_dir
from lexspark.operators import segments
from lexspark.plans.base import SQL, TRUTH_SQL, bm25_sql

#: The settings that job2 studies.
SETTINGS = (
    {"name": "default"},
    {"name": "no_length", "b": 0.0},
    {"name": "saturated", "k1": 0.4},
    {"name": "counts", "ranking": "tf"},
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the index of all documents after two runs, the second of which finds nothing new."""
    folder = _folder(spark, "job1")
    for _ in range(2):
        # As a pattern, since the table may be one file, and a stream wants a folder or a pattern.
        incremental_index.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/checkpoint")
    return segments.live(spark, f"{folder}/out").postings.select("doc_id", "part_index", "lexeme", "tf", "doc_len")


def job2_ranking_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's scores under every setting, after two runs."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        ranking_study.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, SETTINGS)
    rows = spark.read.parquet(f"{folder}/questions")
    return rows.select("setting", "qid", "n_truth", "first", *[F.round(c, 6).alias(c) for c in ("pool", "recall_3", "recall_5", "recall_10")])


_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: Pieces (i, n, room) taken in order while they fit; {0} the result, {1} the pieces, {2} what groups them.
_PACK = """{0} AS (SELECT {2}, i, n, 0::BIGINT AS grp, n::BIGINT AS used FROM {1} WHERE i = 1
  UNION ALL SELECT {3}, p.i, p.n, CASE WHEN g.used > 0 AND g.used + p.n > p.room THEN g.grp + 1 ELSE g.grp END,
    CASE WHEN g.used > 0 AND g.used + p.n > p.room THEN p.n ELSE g.used + p.n END FROM {0} g JOIN {1} p ON {4} AND p.i = g.i + 1)"""
_POSTINGS = rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
raw AS (SELECT doc_id, k, {_STRIP.format("ls[k]")} AS t FROM d, unnest(range(1, len(ls) + 1)) AS r(k)),
piece AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, t, {_WORDS.format("t")} AS n FROM raw WHERE t <> ''),
per AS (SELECT doc_id, 480 - CASE WHEN lang IS NULL THEN 2 ELSE 3 END AS room, string_agg(t, ' ' ORDER BY i) AS whole FROM d JOIN piece USING (doc_id) GROUP BY doc_id, lang),
pieces AS (SELECT p.doc_id, p.i, p.n, room FROM piece p JOIN per USING (doc_id) WHERE {_WORDS.format("whole")} > room),
{_PACK.format("packed", "pieces", "doc_id", "p.doc_id", "p.doc_id = g.doc_id")},
grp AS (SELECT doc_id, grp, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS t FROM packed JOIN piece USING (doc_id, i) GROUP BY ALL),
long AS (SELECT doc_id, grp AS of, room, string_split(regexp_replace(t, '([.;:])\s+', '\1' || chr(31), 'g'), chr(31)) AS ss
  FROM grp JOIN per USING (doc_id) WHERE n = 1 AND {_WORDS.format("t")} > room),
sentence AS (SELECT doc_id, of, room, i, ss[i] AS t, {_WORDS.format("ss[i]")} AS n FROM long, unnest(range(1, len(ss) + 1)) AS r(i)),
{_PACK.format("cut", "sentence", "doc_id, of", "p.doc_id, p.of", "p.doc_id = g.doc_id AND p.of = g.of")},
parts AS (
  SELECT doc_id, 0 AS grp, 0 AS part, whole AS t FROM per WHERE {_WORDS.format("whole")} <= room
  UNION ALL SELECT g.doc_id, grp, 0, t FROM grp g JOIN per USING (doc_id) WHERE n > 1 OR {_WORDS.format("t")} <= room
  UNION ALL SELECT c.doc_id, c.of, c.grp, string_agg(t, ' ' ORDER BY c.i) FROM cut c JOIN sentence USING (doc_id, of, i) GROUP BY c.doc_id, c.of, c.grp),
passage AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) - 1)::INT AS part_index, doc_id || '. ' || t AS content FROM parts),
tok AS (SELECT doc_id, part_index, unnest(regexp_extract_all(lower(content), '([\p{{L}}\p{{N}}]+)', 1)) AS lexeme FROM passage),
counted AS (SELECT doc_id, part_index, lexeme, least(count(*), 256) AS tf FROM tok GROUP BY ALL)
SELECT doc_id, part_index, lexeme, tf, (sum(tf) OVER (PARTITION BY doc_id, part_index))::BIGINT AS doc_len FROM counted"""


def _study() -> str:
    sql, ends = SQL + TRUTH_SQL, []
    for i, s in enumerate(SETTINGS):
        if s.get("ranking") == "tf":
            sql += f",\nscored{i} AS (SELECT qid, chunk_id, sum(tf)::DOUBLE AS score FROM terms JOIN asked USING (lexeme) GROUP BY ALL)"
        else:
            sql += bm25_sql(s.get("k1", 1.2), s.get("b", 0.75)).replace("bm AS", f"scored{i} AS")
        sql += f""",
ranked{i} AS (SELECT * FROM (SELECT qid, act, article, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored{i} JOIN chunks USING (chunk_id)) WHERE rank <= 50),
articles{i} AS (SELECT qid, act, article, row_number() OVER (PARTITION BY qid ORDER BY best, act, article) AS rank FROM (SELECT qid, act, article, min(rank) AS best FROM ranked{i} GROUP BY qid, act, article))"""
        parts = ", ".join(f"round(count(*) FILTER (rank <= {k}) / count(*), 6)::DOUBLE AS recall_{k}" for k in (3, 5, 10))
        ends.append(f"SELECT '{s['name']}' AS setting, qid, count(*) AS n_truth, min(rank) AS first, round(count(rank) / count(*), 6)::DOUBLE AS pool, {parts} FROM (SELECT DISTINCT * FROM truth) LEFT JOIN articles{i} USING (qid, act, article) GROUP BY qid")
    return sql + "\n" + "\nUNION ALL ".join(ends)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_incremental_index, job2_ranking_study)}
ORACLE_SQL: dict[str, str] = {"job1_incremental_index": _POSTINGS, "job2_ranking_study": _study()}
