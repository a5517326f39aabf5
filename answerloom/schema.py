"""Declared schemas of the stored tables and the check every writer runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

DOCUMENTS = "doc_id bigint, kb_id string, doc_name string, ext string, sha256 string, status string, parser string, page_count int, char_count bigint, chunk_count bigint, token_count bigint, error_code string, error_message string, created_at timestamp_ntz, deleted_at timestamp_ntz"
CHUNKS = "kb_id string, chunk_key string, doc_id bigint, chunk_index int, content string, parent_content string, char_count int, token_count int, page_no int, section_path string"
VECTORS = "kb_id string, chunk_key string, doc_id bigint, embedding array<float>"
POSTINGS = "kb_id string, chunk_key string, dl int, term string, tf int"
DOC_STATS = "kb_id string, chunk_key string, dl int"
TERMS = "kb_id string, term string, df bigint"
CORPUS = "kb_id string, n bigint, total_dl bigint, avgdl double"
COLLECTIONS = "kb_id string, generation string"
HEAD = "version bigint, generation string, batch bigint"
CASES = "dataset string, question string, ground_truth string, expected_doc string, expected_sections array<string>, tags array<string>"
TRACES = "trace_id bigint, created_at timestamp_ntz, mode string, status string, latency_ms int, prompt_tokens int, completion_tokens int, llm_calls int, refusal boolean, source_count int, retrieval_rounds int, model string, cost_usd decimal(12,6)"
SPANS = "trace_id bigint, created_at timestamp_ntz, seq int, name string, span_type string, duration_ms int, status string"
MESSAGES = "conv_id bigint, turn bigint, message_id bigint, trace_id bigint, role string, text string, model string, prompt_tokens int, completion_tokens int, cost_usd decimal(12,6)"


def conform(df: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` to a declared schema: required columns must exist, other missing ones become NULL."""
    want = T.StructType.fromDDL(schema)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields
    ]
    return df.select(*cols)
