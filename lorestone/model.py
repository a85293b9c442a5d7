"""Schemas, ids and closed vocabularies of a knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies.
ARTIFACT_LABELS = ("Module", "Class", "Function", "Method", "OpenApiSpec", "OpenApiOperation", "OpenApiSchema", "MarkdownSection")
KB_LINK_KINDS = ("depends_on", "fork_of", "references", "related_to", "mirrors")
RELATES_KINDS = ("imports", "inherits_from", "implements", "calls", "references", "documents")
ANNOTATION_KINDS = ("summary", "gotcha", "caveat", "note")
CONTENT_TYPES = ("text", "code", "table", "mixed")
CHUNK_KINDS = ("text", "code", "openapi_operation", "openapi_schema", "markdown_section")
HTTP_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

CHUNKS = (
    "file_path string, content string, header_breadcrumb string, section_breadcrumb string, chunk_level int, chunk_index int, frontmatter string, labels array<string>, "
    "chunk_id string, parent_chunk_id string, content_type string, kind string, language string, artifact_qualname string, parent_document_id string, vector array<float>"
)
MANIFEST = "file_path string, content_hash string, mtime double, indexed_at double, chunk_count int"
CACHE = "content_hash string, model string, dimensions int, vector array<float>, created_at bigint, accessed_at bigint"
NODES = "id string, label string, kb_name string, properties map<string,string>"
EDGES = "from_id string, to_id string, rel_type string, kind string, properties map<string,string>"
ANNOTATIONS = "id string, target_id string, kind string, body string, tags array<string>, author string, created_at timestamp, updated_at timestamp, target_snapshot string"


def document_id(kb: Column, path: Column) -> Column:
    return F.concat(kb, F.lit("::"), path)


def section_id(doc_id: Column, breadcrumb: Column) -> Column:
    return F.concat(doc_id, F.lit("::"), breadcrumb)


def checked(value: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value; an error at run time if it is not null and not in the vocabulary."""
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))


def checked_vector(vector: Column, dimensions: int) -> Column:
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.raise_error(F.concat(F.lit(f"vector is not of {dimensions} dimensions but "), F.size(vector).cast("string"))))
