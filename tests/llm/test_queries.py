"""The registered queries: the contract's columns on whole tables, and the SQL where there is one."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import TABLES, rows

import __spark_entry__ as entry
import corpus_pipeline
from lexspark.llm import catalog

COLUMNS = {
    "op1_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_html_wrappers": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op5_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_gone": "bigint", "gone_lines": "array<int>", "n_chars_kept": "bigint", "kept_sha256": "string"},
    "op11_token_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op12_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_query(spark, sf_dir, name):
    found = entry.queries()[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = found.toPandas()
    table = {"op2_html_wrappers": "pages", "op5_url_filter": "pages", "op4_chat_formatting": "conversations"}.get(name, "documents")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    key = {"pages": "page_id", "conversations": "conv_id", "documents": "doc_id"}[table]
    if name == "op12_spelling_variants":
        assert got["word"].is_unique and len(got) > 1000
        source, key = found.select(F.col("word")), "word"
    want = sorted(r[0] for r in (source.select(key).distinct() if table == "conversations" else source.select(key)).collect())
    assert sorted(got[key]) == ([-1] if table == "conversations" else []) + want
    if name in catalog.ORACLE_SQL:
        duck = duckdb.connect()
        for t in TABLES.split():
            duck.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        assert rows(got) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_stages_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "token_ids"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
