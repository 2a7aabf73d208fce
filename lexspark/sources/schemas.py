"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

PAGE_TEXT = "act string, number int, text string"
#: Fetched files: each turn adds rows, content is null where error is not.
FETCHED = "turn long, file_name string, url string, bytes long, digest string, content binary, error string"
GLYPH = "page int, line int, pos int, text string, size double, x0 double, x1 double, bottom double"
CHUNK = (
    "act string, article string, article_display string, paragraph string, part_index int, title_path array<string>, "
    "page_start int, repealed boolean, repeal_kind string, content string, n_tokens long"
)
GOLD = (
    "id string, question string, ground_truth_articles array<string>, topic string, act string, source_url string, "
    "evidence string, reference_answer string, notes string"
)
ACT = (
    "slug string, title_pl string, title_en string, eli string, publisher string, year int, pos int, variant string, "
    "variant_meaning string, url string, file_name string, sha256 string, pdf_creation_date string, pages int, "
    "fetched_at string, notes array<string>"
)
CONTEXT = (
    "commit string, branch string, timestamp string, embedding_model string, embedding_revision string, model_cheap string, "
    "model_strong string, retrieval_config_hash string, corpus_manifest_sha string, api_cost_usd double, duration_s double"
)
METRICS = (
    "layer string, n_questions long, recall_at_k map<string,double>, mrr double, faithfulness double, "
    "misses_at_5 array<string>, n_contracts long, n_planted_violations long, `precision` double, recall double, f1 double, "
    "per_violation_type map<string,double>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def history(with_seq: bool = True) -> T.StructType:
    seq = [T.StructField("run_seq", T.LongType())] if with_seq else []
    return T.StructType([*seq, T.StructField("context", struct(CONTEXT)), T.StructField("metrics", struct(METRICS))])
