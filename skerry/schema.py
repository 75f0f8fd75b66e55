"""Row types of the engine; persisted columns are never null."""

from __future__ import annotations

SCHEMA_VERSION = 2

DOCUMENT = "id string, namespace string, uri string, title string, text string, content_hash string, metadata map<string,string>, indexed_at timestamp"
FAILURE = "uri string, reason string"
BLOCK = "struct<heading_path:array<string>,text:string,char_start:long,char_end:long>"
PARSED = f"struct<title:string,text:string,blocks:array<{BLOCK}>>"
CHUNK = "id string, doc_id string, namespace string, uri string, title string, heading_path array<string>, text string, char_start long, char_end long, tokens long, hash string"
STORED_CHUNK = CHUNK + ", embedding array<float>"
INDEXED_DOCUMENT = "doc_id string, content_hash string"
QUESTION = "id string, type string, q string, evidence array<string>, note string"

CHUNK_COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
