"""Continuous ingestion and per-conversation state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.chunking import chunk_sections, with_keywords
from quarry.operators.memory import add_all
from quarry.sources.documents import file_stem, parsed


def ingest_files(files: DataFrame, target: str, epoch: int | str, parse_pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Chunks and jobs of ``files`` (path, content), written below ``target`` under the number ``epoch`` in place of what was there; gives the jobs."""
    spark = files.sparkSession
    parsed(files, parse_pdf).write.mode("overwrite").parquet(f"{target}/sections/epoch={epoch}")
    parts = spark.read.parquet(f"{target}/sections/epoch={epoch}")
    chunks = with_keywords(chunk_sections(parts.where("error is null").select("kb_id", "pos", "label", "text")))
    chunks.write.mode("overwrite").parquet(f"{target}/chunks/epoch={epoch}")
    made = spark.read.parquet(f"{target}/chunks/epoch={epoch}").select("kb_id").distinct().withColumn("__m", F.lit(True))
    by_file = parts.groupBy("path", "kb_id").agg(F.first("error", ignorenulls=True).alias("error")).join(made, "kb_id", "left")
    error = F.when(F.col("__m").isNull(), F.coalesce("error", F.lit("No chunks created")))
    jobs = by_file.select("path", F.when(F.col("__m"), "completed").otherwise("failed").alias("status"), error.alias("error"))
    jobs.write.mode("overwrite").parquet(f"{target}/jobs/epoch={epoch}")
    return spark.read.parquet(f"{target}/jobs/epoch={epoch}")


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, parse_pdf: Callable[[bytes], list[str]] | None = None) -> StreamingQuery:
    """Read text, ePUB and (with a parser) PDF files as they come, chunk them, and append chunks (kb_id, index, location_label, content,
    keywords) and a job row for each file (path, status, error) as Parquet below ``target``. A file that gives no chunks fails without
    stopping the others. A batch that is run again replaces its own files."""

    def batch(df: DataFrame, epoch: int) -> None:
        ingest_files(df.select("path", "content"), target, epoch, parse_pdf)

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.*").option("maxFilesPerTrigger", files_per_batch).load(source)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queued(files: DataFrame, domain: str | None = None, before: DataFrame | None = None) -> DataFrame:
    """Jobs (path, file_name, status, error, domain_id, arrived) for files (path, and arrived where their order is known) that wait.

    ``arrived`` numbers them in order, after those of the jobs ``before`` them; without such a column, in the order of the files' rows.
    """
    place = F.col("arrived").cast("long") if "arrived" in files.columns else F.monotonically_increasing_id()
    jobs = files.select("path", file_stem(F.col("path")).alias("file_name"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(domain).cast("string").alias("domain_id"), place.alias("arrived"))
    if before is None:
        return jobs
    last = before.agg(F.coalesce(F.max("arrived"), F.lit(-1)).alias("__last"))
    first = jobs.agg(F.min("arrived").alias("__first"))
    moved = jobs.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(first)).withColumn("arrived", F.col("arrived") - F.col("__first") + F.col("__last") + 1)
    return before.unionByName(moved.drop("__last", "__first"))


def progressed(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """``jobs`` with the outcome (path, status, error) of those that ran; of those that still wait the first to arrive is processed.

    Jobs that were cancelled, or are in work, keep their state.
    """
    known = jobs.withColumnsRenamed({"status": "__was", "error": "__why"}).join(done.select("path", F.col("status").alias("__s"), F.col("error").alias("__e")), "path", "left")
    busy = F.bool_or(F.col("__s").isNull() & (F.col("__was") == "processing"))
    waiting = known.agg(F.coalesce(busy, F.lit(False)).alias("__busy"), F.min(F.when(F.col("__s").isNull() & (F.col("__was") == "queued"), F.struct("arrived", "path"))).alias("__next"))
    mine = (F.col("__was") == "queued") & ~F.col("__busy") & (F.struct("arrived", "path") == F.col("__next"))
    status = F.coalesce("__s", F.when(mine, "processing").otherwise(F.col("__was")))
    out = known.crossJoin(F.broadcast(waiting)).withColumns({"status": status, "error": F.when(F.col("__s").isNotNull(), F.col("__e")).otherwise(F.col("__why"))})
    return out.select(*jobs.columns)


def cancelled(jobs: DataFrame) -> DataFrame:
    """Jobs that wait fail as "Cancelled"; others go on."""
    wait = F.col("status") == "queued"
    return jobs.withColumns({"error": F.when(wait, "Cancelled").otherwise(F.col("error")), "status": F.when(wait, "failed").otherwise(F.col("status"))})


def removed(jobs: DataFrame, path: str) -> DataFrame:
    return jobs.where(F.col("path") != path)


def unfinished(jobs: DataFrame) -> DataFrame:
    """Without jobs that are completed or failed."""
    return jobs.where(~F.col("status").isin("completed", "failed"))


def memory_stream(adds: DataFrame, capacity: int = 100) -> DataFrame:
    """(log, seq, content): the adds of a stream (log, seq, content) that a capped log without repeats takes. Its state are the held entries."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        taken = []
        for seq, content in zip(rows["seq"], rows["content"], strict=True):
            after = add_all(held, iter([(seq, content)]), capacity)
            if after[-1:] == [(seq, content)] and (not held or held[-1] != (seq, content)):
                taken.append((key[0], seq, content))
            held = after
        state.update(([int(s) for s, _ in held], [c for _, c in held]))
        yield pd.DataFrame(taken, columns=["log", "seq", "content"])

    return adds.groupBy("log").applyInPandasWithState(fold, "log string, seq long, content string", "seqs array<long>, contents array<string>", "append", GroupStateTimeout.NoTimeout)


def rotations(messages: DataFrame, most_turns: int = 6) -> DataFrame:
    """(conv_id, turn, rotated_at) for a stream of messages (conv_id, turn, role): after every ``most_turns`` answers a conversation's
    context is rotated and its count begins anew. Its state is the number of turns since."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, done = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("turn")
        for turn, role in zip(rows["turn"], rows["role"], strict=True):
            if role == "user" and turns >= most_turns:
                done += 1
                out.append((key[0], turn, done))
                turns = 0
            turns += role == "assistant"
        state.update((int(turns), int(done)))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "rotated"])

    return messages.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, turn long, rotated long", "turns long, done long", "append", GroupStateTimeout.NoTimeout)
