"""Storage statistics and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schemas import VECTOR_BYTES


def storage_size(content: Column, embedding: Column) -> Column:
    """An aggregate: UTF-8 bytes of the contents and a fixed size for each vector."""
    return F.coalesce(F.sum(F.octet_length(content)), F.lit(0)) + VECTOR_BYTES * F.count(embedding)


def storage_by(chunks: DataFrame, key: str | None = None) -> DataFrame:
    """chunks and bytes (long), in all or by a key."""
    return chunks.groupBy(*([key] if key else [])).agg(F.count(F.lit(1)).alias("chunks"), storage_size(F.col("content"), F.col("embedding")).alias("bytes"))


def json_size(*columns: str) -> Column:
    """An aggregate: bytes of the rows as JSON."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0))


def queue_progress(status: Column) -> Column:
    """An aggregate: finished jobs count 1, the one in work 0.5, queued ones 0; 0 for no jobs."""
    return F.coalesce(F.avg(F.when(status.isin("completed", "failed"), 1.0).when(status == "processing", 0.5).otherwise(0.0)), F.lit(0.0))


def schema_chars(name: Column, description: Column, each: int = 80) -> Column:
    """An aggregate: characters that tool descriptions take in a prompt."""
    return F.coalesce(F.sum(F.length(name) + F.length(description) + each), F.lit(0))


def base_totals(bases: DataFrame) -> DataFrame:
    """One row: file_size and chunk_count in all, how many knowledge bases there are and how many have no domain."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return bases.agg(total("file_size"), total("chunk_count"), F.count(F.lit(1)).alias("bases"), F.count_if(F.col("domain_id").isNull()).alias("orphans"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def stored_bytes(conversations: DataFrame, memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: bytes of conversations and memories as JSON, of chunks and vectors (content, embedding), and in all."""
    one = conversations.agg(json_size(*conversations.columns).alias("conversation_bytes")).crossJoin(memories.agg(json_size(*memories.columns).alias("memory_bytes")))
    out = one.crossJoin(storage_by(chunks).select(F.col("bytes").alias("chunk_bytes")))
    return out.withColumn("bytes", F.col("conversation_bytes") + F.col("memory_bytes") + F.col("chunk_bytes"))
