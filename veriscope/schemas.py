"""Row types of the relations that operators exchange."""

EVIDENCE = "array<struct<document_external_id: string, fact: string, sentence_ids: array<int>>>"
DOCUMENTS = "external_id string, title string, body string, metadata map<string, string>"
QUESTIONS = f"external_id string, question string, answer string, question_type string, gold_evidence {EVIDENCE}, metadata map<string, string>"
CHUNKS = "index_id string, document_id string, ordinal int, text string"
RANKING = "question_id long, chunk_id long, document_id string, score double, rank int, source string"
PREDICTIONS = (
    "run_id long, question_id long, contexts array<struct<chunk_id: long, document_external_id: string, text: string, score: double, "
    "rank: int, source: string>>, answer string, abstained boolean, retrieval_ms int, generation_ms int, prompt_tokens int, "
    "completion_tokens int, error string"
)
SCORES = "run_id long, question_id long, evaluator string, metric string, value double, detail string"
ANNOTATIONS = "run_id long, question_id long, metric string, value double, annotator string, notes string"
CONFIGS = "hash string, name string, payload string"
INDEXES = "index_id string, dataset string, index_hash string, n_chunks long, dim int"
RUNS = (
    "run_id long, config_hash string, dataset string, index_id string, label string, status string, warnings array<string>, n_questions long, "
    "n_failed long, usage string, created timestamp, finished timestamp"
)

#: Natural keys, by which an upsert replaces rows.
KEYS = {
    "datasets": ["name"],
    "documents": ["dataset", "external_id"],
    "questions": ["dataset", "external_id"],
    "indexes": ["index_id"],
    "chunks": ["index_id", "document_id", "ordinal"],
    "configs": ["hash"],
    "runs": ["run_id"],
    "predictions": ["run_id", "question_id"],
    "scores": ["run_id", "question_id", "evaluator", "metric"],
    "annotations": ["run_id", "question_id", "metric", "annotator"],
}
