"""Schemas of every stored table, as DDL; nothing is inferred."""

RECORD_FIELDS = ("project_name", "doc_type", "department", "equipment_tag")
INDEXED_FIELDS = (*RECORD_FIELDS, "year")

FILES = "file_path string, mtime double, size long"
MANIFEST = "file_path string, mtime double, size long, doc_id string"
RECORDS = (
    "doc_id string, file_path string, file_name string, file_ext string, project_name string, doc_type string, "
    "department string, equipment_tag string, year int, keywords array<string>, source_of_metadata string, "
    "extraction_status string, ocr_confidence double, indexed_at string, schema_version int"
)
QUERIES = "query_id int, raw_query string"
EXTRACTION_LOG = "timestamp string, file_path string, source string, confidence double, text string"
REVIEW_QUEUE = "timestamp string, file_path string, reason string, confidence double"
INDEX_RUNS = "timestamp string, corpus_root string, total_files long, processed long, skipped_unchanged long, corpus_root_changed boolean"
FEEDBACK = "timestamp string, query string, top_doc_ids array<string>, scores array<double>, ambiguous boolean, used_llm_rerank boolean, chosen_doc_id string, correct boolean"
FIELD_STATS = "field_name string, current_weight double, correct long, incorrect long, samples long, precision double"

STATUS_OK, STATUS_PENDING, STATUS_REVIEW = "ok", "pending_deep_scan", "needs_review"
