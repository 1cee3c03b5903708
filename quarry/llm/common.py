"""Helpers shared by the training-data operators: durable cuts of lineage and a vectorised byte kernel."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of fixed-width columns is broadcast only if it takes at most so many bytes in memory; beyond it the plan shuffles.
BROADCAST_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a new local folder is set if all runs in one process (as in tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the cut tables of each open scope, the innermost last.
_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: no lineage is left, and a lost executor costs nothing.

    In a ``scope`` the table goes with it; with ``keep`` it goes with the scope around that, if there is one.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut in here are deleted at the end, so nothing lazy may refer to them beyond it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, at 40 bytes and 16 for each fixed-width value, take at most ``most_bytes``, else unchanged.

    ``df`` is a cut table: its rows are counted from the footers of its files.
    """

    def values(kind) -> int:
        return sum(values(f.dataType) for f in kind.fields) if hasattr(kind, "fields") else 1

    return F.broadcast(df) if df.count() * (40 + 16 * values(df.schema)) <= most_bytes else df


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a number as doc_id that no other row has and that sorts as doc_id does (none: last), and doc_id as ``named``; and
    whether the numbers are new.

    So rows without a doc_id, or with one that others have too, are documents of their own. Where doc_id is such a number already, it is
    taken, and no texts are written.
    """
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return docs.withColumn("named", F.col("doc_id")), False
    rows = docs.sort(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn("named", F.col("doc_id"))
    return cut(rows.withColumn("doc_id", F.monotonically_increasing_id()), "numbered"), True


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def running(values: Column, combine, none: Column) -> Column:
    """The running totals of an array under ``combine``, for which ``none`` changes nothing, by doubling steps: no array grows entry by entry."""
    n = F.size(values)
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def double(x: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(x, F.concat(F.array_repeat(none, shift), F.slice(x, F.lit(1), F.greatest(n - shift, F.lit(0)))), combine)

    return F.aggregate(steps, values, double)


# --- byte kernel -------------------------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Keeps the first k bytes of a little-endian word, for k from 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``: equal spans, equal values.

    Each run of 8 bytes of a span is scrambled together with its place in the span before the runs are summed, so no byte's part in the
    sum is a multiple of another's. Spans of one length up to 8 never collide. ``seed`` picks an independent function.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    runs = np.maximum(1, (lengths + 7) >> 3)
    first = np.cumsum(runs) - runs
    place = np.arange(int(runs.sum()), dtype=np.int64) - np.repeat(first, runs)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.repeat(lengths, runs) - (place << 3)
    values = words[np.minimum(np.repeat(starts, runs) + (place << 3), len(data))] & _FIRST[np.clip(left, 0, 8)]
    salt = mix(place.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    return mix(np.add.reduceat(mix(values ^ salt), first) + lengths.astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each text (cut at ``offsets``) the index of its first word."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], ink[:-1])) if len(ink) else ink
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate((ink[1:], [False])) if len(ink) else ink
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def text_pieces(column: pa.Array | pa.ChunkedArray, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts by rows [i, j) with at most ``most`` bytes together, or a single row: i, j, their bytes, their offsets. Null: no bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    at = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk, "")
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, index, data = chunk.buffers()
        offsets = np.frombuffer(index, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield at + i, at + j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        at += len(chunk)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def arrow_batches(fn):
    """A function for ``mapInArrow`` from one that takes a record batch and yields record batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return run
