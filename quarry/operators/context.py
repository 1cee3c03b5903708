"""Packing of retrieved rows into a prompt with a budget in characters, and estimates of context use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The texts around the packed context.
MEMORY_HEAD = "Remembered context from previous conversations:\n"
CHUNK_HEAD = "Relevant knowledge base excerpts:\n"
NOTE = (
    "\n\n---\nNote: The following is supplementary reference material that MAY be relevant. Only use it if it directly relates to the question above. "
    "Otherwise rely on your own knowledge.\n\n"
)


def within_budget(rows: DataFrame, group: str, order: str, length: Column, budget: Column | int) -> DataFrame:
    """The leading rows of each group whose lengths together stay within the budget; the first that doesn't ends it."""
    used = F.sum(length).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("__used", used).where(F.col("__used") <= budget).drop("__used")


def pack_context(questions: DataFrame, memories: DataFrame, chunks: DataFrame, budget: int = 1500) -> DataFrame:
    """(query_id, prompt, memory_count, chunk_count, document_names) for questions (query_id, text).

    ``memories`` (query_id, rank, content) all go in; ``chunks`` (query_id, rank, label, content, name) share what they leave of the
    budget. A question for which nothing is found stays as it is.
    """
    held = memories.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("__m"))
    held = held.select("query_id", F.array_join(F.transform("__m", lambda m: F.concat(F.lit("- "), m["content"])), "\n").alias("__mem"), F.size("__m").cast("long").alias("memory_count"))
    base = questions.join(held, "query_id", "left").withColumn("__left", F.lit(budget) - F.coalesce(F.length("__mem"), F.lit(0)))
    text = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("content"))
    open_ = chunks.join(base.select("query_id", "__left"), "query_id").withColumn("__t", text)
    packed = within_budget(open_, "query_id", "rank", F.length("__t"), F.col("__left"))
    packed = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("__t").alias("t")))).alias("__c"), F.array_sort(F.collect_set("name")).alias("document_names"))
    out = base.join(packed, "query_id", "left")
    excerpts = F.array_join(F.transform("__c", lambda c: c["t"]), "\n---\n")
    blocks = F.concat_ws("\n\n", F.when(F.col("__mem").isNotNull(), F.concat(F.lit(MEMORY_HEAD), F.col("__mem"))), F.when(F.col("__c").isNotNull(), F.concat(F.lit(CHUNK_HEAD), excerpts)))
    prompt = F.when(blocks == "", F.col("text")).otherwise(F.concat("text", F.lit(NOTE), blocks))
    return out.select("query_id", prompt.alias("prompt"), F.coalesce("memory_count", F.lit(0)).alias("memory_count"), F.coalesce(F.size("__c"), F.lit(0)).cast("long").alias("chunk_count"), F.coalesce("document_names", F.array().cast("array<string>")).alias("document_names"))


def context_summary(memories: Column, chunks: Column, names: Column) -> Column:
    """One line on what was found, as "2 memories · 1 chunk from a, b"."""
    m = F.when(memories > 0, F.concat(memories.cast("string"), F.when(memories == 1, " memory").otherwise(" memories")))
    c = F.when(chunks > 0, F.concat(chunks.cast("string"), F.when(chunks == 1, " chunk").otherwise(" chunks"), F.when(F.size(names) > 0, F.concat(F.lit(" from "), F.array_join(names, ", "))).otherwise("")))
    return F.concat_ws(" · ", m, c)


def context_usage(messages: DataFrame, key: str, order: str, content: str, turns: int, overhead: int = 0, per_token: float = 3.5, window: int = 4096) -> DataFrame:
    """(key, usage): the share of the window that the last two messages a turn, and ``overhead`` characters, take; at most 1."""
    last = messages.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= 2 * turns)
    usage = F.least((F.sum(F.length(content)) + overhead) / per_token / window, F.lit(1.0))
    return last.groupBy(key).agg(usage.alias("usage"))


def context_level(usage: Column) -> Column:
    """How full the context is."""
    return F.when(usage > 0.85, "high").when(usage > 0.6, "medium").otherwise("low")
