"""The mailbox of shared texts: a stream of files, each item read once, then routed to the memory log or to a new conversation.

Files (JSON lines with ``text`` and ``action``) are moved to an archive when they have been read. A batch writes what it makes below folders of its own
number and replaces them if it runs again; the log is written as a whole, from that of the batch before. So a batch that died between two
sinks is repeated without loss and without doubles. Readers take ``memories``, ``heads`` and ``messages`` of all batches, and the log of the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quarry.functions.text import auto_title, trim_space
from quarry.operators.memory import memory_log
from quarry.operators.workers import shared_memories, shared_messages

ITEM = "text string, action string"
LOG = "log string, seq long, content string"


def items(rows: DataFrame) -> DataFrame:
    """(id, text, action) of a batch's rows (path, text, action): ids by file and content, numbered where lines of a file are equal; blank texts are left out."""
    nth = F.row_number().over(W.partitionBy("path", "text", "action").orderBy(F.lit(1)))
    return rows.where(trim_space(F.col("text")) != "").select(F.sha2(F.concat_ws("\x1f", "path", "text", "action", nth.cast("string")), 256).alias("id"), "text", "action")


def dispatched(spark: SparkSession, batch: DataFrame, number: int, target: str, capacity: int = 100, after_memories=None) -> None:
    """Write what one batch (path, text, action) makes: memories and the log, then conversations with their first message."""
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{target}/log/batch=-1")
    items(batch).write.mode("overwrite").parquet(f"{target}/items/batch={number}")
    now = spark.read.parquet(f"{target}/items/batch={number}")
    shared_memories(now).write.mode("overwrite").parquet(f"{target}/memories/batch={number}")
    before = spark.read.parquet(f"{target}/log").where(F.col("batch") < number)
    last = before.agg(F.max("batch").alias("batch"))  # an empty log has no rows, so the one before may be older
    held = before.join(F.broadcast(last), "batch").select("log", "seq", "content")
    fresh = spark.read.parquet(f"{target}/memories/batch={number}").select(F.lit("memories").alias("log"), F.lit(number).cast("long").alias("seq"), "content")
    memory_log(held.unionByName(fresh), capacity).write.mode("overwrite").parquet(f"{target}/log/batch={number}")
    if after_memories:
        after_memories(number)
    messages = shared_messages(now)
    messages.select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "role", "content").write.mode("overwrite").parquet(f"{target}/messages/batch={number}")
    messages.select("id", auto_title(F.col("content")).alias("title")).write.mode("overwrite").parquet(f"{target}/heads/batch={number}")


def mailbox_stream(spark: SparkSession, source: str, archive: str, target: str, checkpoint: str, capacity: int = 100, files: int = 100, after_memories=None) -> StreamingQuery:
    """Consume the mailbox ``source`` until it is empty; what was read goes to ``archive`` (a folder outside of it)."""

    def route(batch: DataFrame, number: int) -> None:
        dispatched(batch.sparkSession, batch, number, target, capacity, after_memories)

    reader = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files).option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.json(source).select(F.col("_metadata.file_path").alias("path"), "text", "action")
    return rows.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_log(spark: SparkSession, target: str) -> DataFrame:
    """The memory log after the last batch that wrote one."""
    log = spark.read.parquet(f"{target}/log")
    return log.join(F.broadcast(log.agg(F.max("batch").alias("batch"))), "batch").select("seq", "content")
