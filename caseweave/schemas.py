"""Tables of a workspace, as schemas. Nothing is inferred."""

from __future__ import annotations

# Columns and types.
SCHEMAS = {
    "store_meta": "key string, value string",
    "casefiles": "id string, slug string, title string, description string, created_at timestamp, updated_at timestamp",
    "documents": "id string, casefile_id string, content_hash string, filename string, media_type string, byte_size bigint, extracted_text string, extractor string, text_source string, summary string, summary_by string, created_at timestamp, updated_at timestamp, parent_id string, containment_path string, identity_path string",
    "document_places": "document_id string, location_path string, first_seen_at timestamp",
    "chunks": "chunk_id string, document_id string, casefile_id string, ordinal int, heading_path string, text string, char_start int, char_end int, summary string",
    "chunk_vectors": "chunk_id string, embedding array<float>",
    "mentions": "chunk_id string, document_id string, casefile_id string, ordinal int, kind string, value string, normalised string, char_start int, char_end int, document_offset int, extractor string, confidence double",
    "ingest_runs": "id string, casefile_id string, started_at timestamp, finished_at timestamp, documents_before int, documents_after int, items_ingested int, items_failed int, entries_refused int, files_without_extractor int, exhausted_by string",
    "postings": "term string, casefile_id string, chunk_id string, document_id string, ordinal int, dl int, tf bigint",
    "passage_statistics": "casefile_id string, passages bigint, words bigint",
}
#: Tables of the whole store; all others are kept by casefile.
GLOBAL = ("store_meta", "casefiles")
#: Tables with rows of a document, by the column that says which.
OF_DOCUMENT = {"document_places": "document_id", "chunks": "document_id", "mentions": "document_id", "postings": "document_id"}
#: The version of these tables, and of their layout.
VERSION = 2
