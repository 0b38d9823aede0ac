"""Schemas of all tables, as DDL. Files are always read with one of these, never inferred."""

MANIFEST = "doc_id STRING, local_path STRING, source_url STRING, published_url STRING, repo STRING, commit STRING, license STRING, retrieved_at STRING, sha256 STRING, bytes BIGINT"
CHUNK = "chunk_id STRING, doc_id STRING, url STRING, source_url STRING, heading_path ARRAY<STRING>, text STRING, n_tokens INT, ordinal INT"
QUESTION = (
    "id STRING, split STRING, category STRING, subtype STRING, question STRING, expected STRING, reference_answer STRING, "
    "evidence ARRAY<STRUCT<doc_id: STRING, quote: STRING>>, source STRING, draft_id STRING, reviewed BOOLEAN, notes STRING"
)
VERDICT = "STRUCT<claims: ARRAY<STRUCT<claim: STRING, supported: BOOLEAN>>, correctness: INT, correctness_reason: STRING>"
RECORD = (
    "qid STRING, config STRING, split STRING, category STRING, subtype STRING, expected STRING, question STRING, reference STRING, "
    "retrieved_ids ARRAY<STRING>, top_rerank_score DOUBLE, gold_groups ARRAY<ARRAY<STRING>>, answer STRING, abstained BOOLEAN, "
    "abstain_reason STRING, cited_ids ARRAY<STRING>, citation_valid BOOLEAN, citation_first_attempt_valid BOOLEAN, "
    "n_uncited_sentences INT, citations_requested BOOLEAN, n_llm_calls INT, input_tokens INT, output_tokens INT, "
    f"retrieval_s DOUBLE, generation_s DOUBLE, verdict {VERDICT}, judge_error STRING, judge_tokens INT, created_at STRING"
)
PROBE = "question STRING, evidence STRING, doc_id STRING, heading_path ARRAY<STRING>"
USAGE = (
    "event STRING, user STRING, channel STRING, question STRING, retrieved ARRAY<STRING>, cited ARRAY<STRING>, answer STRING, "
    "abstained BOOLEAN, abstain_reason STRING, citation_valid BOOLEAN, retrieval_s DOUBLE, total_s DOUBLE, "
    "input_tokens BIGINT, output_tokens BIGINT, scope STRING, timestamp TIMESTAMP, level STRING"
)
#: Values of fields that older files lack.
DEFAULTS = {"abstained": False, "citations_requested": True, "n_llm_calls": 0, "judge_tokens": 0}
