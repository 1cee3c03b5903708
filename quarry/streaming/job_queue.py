"""The ingest queue as one keyed state that files and commands both steer.

Files to ingest, commands and outcomes are events, small JSON files of one stream. The state of a queue knows its jobs by their number of
arrival. One job at a time is in work; when it ends, the next one that waits begins. A cancel lets the job in work end and fails all that wait. What
begins in a batch is ingested by that batch, which then sends the outcome as an event of its own; so a batch that runs again does the same.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from quarry.storage import write_small
from quarry.streaming.ingest import ingest_files

EVENT = "queue string, at long, kind string, path string, arrival long, status string, error string"
STEP = "queue string, step long, arrival long, path string, status string, error string"


def send(spark: SparkSession, events: str, queue: str, kind: str, path: str | None = None, name: str | None = None, **more) -> None:
    """An event, ``file`` (with a path) or ``cancel``, at this time; a named one replaces what has its name."""
    at = time.time_ns()
    write_small(spark, f"{events}/{name or f'{at}-{kind}'}.json", json.dumps({"queue": queue, "at": at, "kind": kind, "path": path} | more))


class Queue(StatefulProcessor):
    """Jobs by number of arrival; how many arrived, the first that may wait, the one in work (-1: none), and how many steps were told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        job = StructType().add("path", StringType()).add("status", StringType())
        self.jobs = handle.getMapState("jobs", StructType().add("arrival", LongType()), job)
        counts = StructType()
        for name in ("arrived", "first", "busy", "steps"):
            counts = counts.add(name, LongType())
        self.counts = handle.getValueState("counts", counts)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, first, busy, steps = (int(x) for x in self.counts.get()) if self.counts.exists() else (0, 0, -1, 0)
        out = []

        def told(arrival: int, path: str, status: str, error: str | None = None) -> None:
            nonlocal steps
            self.jobs.updateValue((arrival,), (path, status))
            out.append((key[0], steps, arrival, path, status, error))
            steps += 1

        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        for kind, path, arrival, status, error in zip(*(events[c].tolist() for c in ("kind", "path", "arrival", "status", "error")), strict=True):
            if kind == "file":
                told(arrived, path, "queued")
                arrived += 1
            elif kind == "cancel":
                for n in range(first, arrived):
                    told(n, self.jobs.getValue((n,))[0], "failed", "Cancelled")
                first = arrived
            elif kind == "done" and arrival == busy:  # an outcome that was told already is passed over
                told(busy, path, status, error if isinstance(error, str) else None)
                busy = -1
            if busy < 0 and first < arrived:
                busy, first = first, first + 1
                told(busy, self.jobs.getValue((busy,))[0], "processing")
        self.counts.update((arrived, first, busy, steps))
        yield pd.DataFrame(out, columns=["queue", "step", "arrival", "path", "status", "error"])

    def close(self) -> None:
        pass


def steps_of(events: DataFrame) -> DataFrame:
    """(queue, step, arrival, path, status, error): what becomes of the jobs of a stream of events, step by step."""
    return events.groupBy("queue").transformWithStateInPandas(Queue(), outputStructType=STEP, outputMode="append", timeMode="none")


def run_queue(spark: SparkSession, events: str, target: str, checkpoint: str, parse_pdf: Callable[[bytes], list[str]] | None = None, during=None) -> None:
    """Work until no job waits. Chunks go below ``target``, steps to ``target/steps``. ``during`` is called while a file is in work.

    The session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``)."""
    begun = []

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/steps/batch={number}")
        starts = spark.read.schema(STEP).parquet(f"{target}/steps/batch={number}").where("status = 'processing'")
        for r in starts.collect():  # at most one of each queue
            begun.append(r.path)
            if during:
                during(r.path)
            files = spark.read.format("binaryFile").load(r.path).select("path", "content")
            name = f"{hashlib.sha256(r.queue.encode()).hexdigest()[:12]}-{r.arrival}"
            made = ingest_files(files, target, name, parse_pdf).first()
            send(spark, events, r.queue, "done", r.path, name=f"done-{name}", arrival=r.arrival, status=made.status, error=made.error)

    while True:
        begun.clear()
        stream = steps_of(spark.readStream.schema(EVENT).json(events))
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not begun:
            return


def jobs(spark: SparkSession, target: str) -> DataFrame:
    """(queue, arrival, path, status, error): the last state of each job."""
    steps = spark.read.schema(STEP).parquet(f"{target}/steps")
    return steps.groupBy("queue", "arrival").agg(F.max_by(F.struct("path", "status", "error"), "step").alias("j")).select("queue", "arrival", "j.*")
