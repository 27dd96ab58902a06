"""Schemas of the engine's tables, as DDL."""

WIKILINKS = "array<struct<target_note: string, target_anchor: string, alias: string>>"
EVIDENCE = "array<struct<path: string, anchor: string, block_id: string, heading: string, quote: string, score: double>>"

RAW_NOTES = "path string, modificationTime timestamp, length bigint, content binary"
NOTES = "note_id bigint, path string, mtime_ms bigint, content_hash string, indexed_at bigint"
CHUNKS = f"chunk_id bigint, note_id bigint, path string, heading_path string, block_id string, anchor string, ordinal int, char_start int, char_end int, text string, token_est int, wikilinks {WIKILINKS}, embedding array<float>"
CLAIMS = "answer_id bigint, claim_id int, claim string"
SOURCES = "answer_id bigint, path string, anchor string, text string"
JUDGEMENTS = "answer_id bigint, claim_id int, passage_index int, text string, label string, confidence double"
CHANGE_LOG = "path string, op string, ts timestamp, content string"
REVISIONS = "path string, ts_ms bigint, content string"
VERIFIER_ITEMS = "claim string, passages array<string>, gold string, note string"
E2E_ITEMS = "claim string, expected string, mode string, note string"
