"""Schemas and constants of the data model; nothing is inferred on reading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the well-known id of the default domain.
GENERAL = "00000000-0000-0000-0000-000000000001"
#: Seconds from 1970 to 2001, from which dates in JSON count.
EPOCH_2001 = 978307200
#: Bytes that a stored vector counts for.
VECTOR_BYTES = 4096

DOMAIN = "id string, name string, created_at timestamp, is_default boolean"
KNOWLEDGE_BASE = "id string, name string, document_type string, created_at timestamp, updated_at timestamp, chunk_count bigint, file_size bigint, embedding_model_id string, domain_id string"
KNOWLEDGE_BASE_JSON = "id string, name string, documentType string, createdAt double, updatedAt double, chunkCount bigint, fileSize bigint, embeddingModelID string, domainID string"
CHUNK = "id string, knowledge_base_id string, content string, keywords array<string>, location_label string, index bigint, embedding array<double>"
MEMORY = "id string, content string, keywords array<string>, source_title string, created_at timestamp, embedding array<double>, domain_id string"
MESSAGE = "id string, role string, content string, timestamp timestamp"
CONVERSATION = f"id string, title string, created_at timestamp, messages array<struct<{', '.join(x.replace(' ', ': ', 1) for x in MESSAGE.split(', '))}>>, custom_system_prompt string, domain_id string"
WORKER = "id string, name string, icon string, trigger string, instructions string, is_enabled boolean, is_built_in boolean, created_at timestamp"

# Names and icons of document types; labels, icons and colours of a job's states.
LABELS = {"pdf": "PDF", "epub": "ePUB", "text": "Text"}
ICONS = {"pdf": "doc.richtext", "epub": "book", "text": "doc.text"}
STATES = {
    "queued": ("Queued", "clock", "secondary"),
    "processing": ("Processing…", "arrow.trianglehead.2.clockwise", "blue"),
    "completed": ("Done", "checkmark.circle.fill", "green"),
    "failed": (None, "exclamationmark.triangle.fill", "red"),
}


@dataclass(frozen=True)
class Embedder:
    """What is known of the caller's embedding: the model's name, its dimension, and the function of a text column (None: not available)."""

    model: str
    dimension: int
    function: Callable[[Column], Column] | None = None

    @property
    def available(self) -> bool:
        return self.function is not None


@dataclass(frozen=True)
class RetrievalSettings:
    """Parameters of retrieval plans."""

    memories: bool = True
    documents: bool = True
    max_memories: int = 2
    max_chunks: int = 3
    budget: int = 1500
    auto_extract: bool = True


def effective_domain(domain: Column) -> Column:
    """Null means the default domain."""
    return F.coalesce(domain, F.lit(GENERAL))


def document_type(raw: Column) -> Column:
    """Unknown types count as text."""
    return F.when(raw.isin(*LABELS), raw).otherwise("text")


def type_label(raw: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), document_type(raw))


def type_icon(raw: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ICONS.items() for x in kv)), document_type(raw))


def state_label(status: Column, error: Column) -> Column:
    """A job's state in words: what went wrong, for a failed one."""
    named = {k: v[0] for k, v in STATES.items() if v[0]}
    return F.when(status == "failed", error).otherwise(F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), status))


def state_icon(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in STATES.items() for x in (k, v[1]))), status)


def state_colour(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in STATES.items() for x in (k, v[2]))), status)


def keywords_json(keywords: Column) -> Column:
    """Keywords as JSON; an empty list for null."""
    return F.coalesce(F.to_json(keywords), F.lit("[]"))


def reference_date(seconds: Column) -> Column:
    """A JSON date as a timestamp."""
    return F.timestamp_seconds(seconds + EPOCH_2001)


def json_keywords(text: Column) -> Column:
    """Keywords that are kept as JSON; an empty array for invalid ones."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
