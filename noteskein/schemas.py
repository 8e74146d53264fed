"""Explicit schemas of the core tables as DDL; nothing here is inferred."""

from __future__ import annotations

NOTES = ("id string, label string, content string, modified timestamp, length bigint")

TRIPLES = (
    "source_category string, source_label string, relationship string, "
    "target_category string, target_label string, source_file string, extracted_at string"
)

ENTITIES = ("id string, label string, metadata string")

EDGES = ("edge_type string, src string, dst string, relationship string")

LISTING = ("path string, length bigint, modified timestamp")

TRACKING = (
    "file_id bigint, path string, file_size bigint, modified timestamp, content_hash string, "
    "status string, processed_at timestamp, has_relationships boolean, updated_at timestamp"
)

CHANGES = (
    "file_id bigint, change_type string, old_path string, new_path string, "
    "old_hash string, new_hash string, ts timestamp"
)

FILE_EVENTS = ("vault_id string, path string, change_type string, old_path string, ts timestamp")

TAG_SCHEMA = "array<struct<tag:string,output_type:string,name:string,description:string>>"

TASKS = (
    "id bigint, tag string, task_type string, prompt string, name string, description string, "
    f"model string, output_type string, enabled boolean, tag_schema {TAG_SCHEMA}, "
    "created_at timestamp, updated_at timestamp"
)

RUNS = (
    "id bigint, task_id bigint, note_path string, status string, result string, error string, "
    "model_used string, processing_time_ms bigint, created_at timestamp, completed_at timestamp"
)

RESPONSES = ("chunk_key string, raw string")


def column_names(ddl: str) -> list[str]:
    """Column names of a schema without nested fields."""
    return [field.split()[0] for field in ddl.split(",")]
