"""Tables of the index, as Spark schemas."""

SOURCES = "id string, source_type string, uri string, name string, created_at timestamp, updated_at timestamp, config_json string"
DOCUMENTS = "id string, source_id string, uri string, title string, content_hash string, content_type string, created_at timestamp, updated_at timestamp"
CHUNKS = (
    "id string, doc_id string, chunk_index int, chunk_hash string, chunk_text string, char_start int, char_end int, headings array<string>, point_id string, "
    "modality string, media_url string, media_hash string, created_at timestamp, updated_at timestamp"
)
RUNS = (
    "id string, source_id string, operation string, started_at timestamp, completed_at timestamp, status string, docs_processed int, chunks_created int, "
    "chunks_updated int, chunks_deleted int, errors array<string>"
)
POINTS = (
    "id string, vector array<float>, norm double, source_id string, source_type string, source_uri string, doc_id string, doc_uri string, title string, headings array<string>, "
    "chunk_index int, chunk_hash string, updated_at timestamp, modality string, media_url string, media_hash string"
)
ASSETS = "doc_id string, chunk_index int, url string, alt string, context string, content_type string, sha string, data binary"
TABLES = {"sources": SOURCES, "documents": DOCUMENTS, "chunks": CHUNKS, "runs": RUNS, "points": POINTS, "assets": ASSETS}
#: What tells a row of each table from others.
KEYS = {"sources": ["uri"], "documents": ["source_id", "uri"], "chunks": ["doc_id", "chunk_index"], "runs": ["id"], "points": ["id"], "assets": ["doc_id", "chunk_index"]}
