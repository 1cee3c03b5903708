"""Vector functions as columns, in double precision; and the binary form of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def is_normalized(v: Column, tolerance: float = 0.01) -> Column:
    """The squared length is within the tolerance of 1."""
    return F.abs(dot(v, v) - 1) < tolerance


def normalized(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    n = magnitude(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths or zero length; the plain product where both have length 1."""
    n = magnitude(a) * magnitude(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).when(is_normalized(a) & is_normalized(b), dot(a, b)).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def usable(v: Column, dimension: int) -> Column:
    """There is a vector of this dimension."""
    return v.isNotNull() & (F.size(v) == dimension)


def mean_pooled(vectors: Column) -> Column:
    """The normalised mean of an array of vectors; null if there are none or the mean is zero."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(1))), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when((F.size(vectors) > 0) & (magnitude(total) > 0), normalized(total))


def matrix_rows(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """``rows`` with a vector of this dimension, as floats of length 1 (a zero vector stays as it is)."""
    return rows.where(usable(F.col(vector), dimension)).withColumn(vector, normalized(F.col(vector)).cast("array<float>"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the normalised mean of each key's vectors; sums are made before the shuffle."""
    means = rows.select(key, F.posexplode(vector).alias("__i", "__v")).groupBy(key, "__i").agg(F.avg(F.col("__v").cast("double")).alias("__v"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]).alias(vector))
    return whole.withColumn(vector, F.when(magnitude(F.col(vector)) > 0, normalized(F.col(vector))))


def to_bytes(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the vector (array of doubles) as little-endian doubles. Whole batches are cut from one buffer."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            flat = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<f8")
            ends = (8 * column.offsets.to_numpy()).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(pc.is_valid(column), made, pa.scalar(None, pa.binary()))], names=[*batch.schema.names, name])

    return rows.mapInArrow(of, StructType(list(rows.schema.fields)).add(name, BinaryType()))


def from_bytes(rows: DataFrame, data: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``: the vector of the little-endian doubles in ``data``; bytes that make no whole number are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(data)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // 8
            raw = b"".join(x.as_py()[: 8 * n] if n else b"" for x, n in zip(column, sizes, strict=True)) if (pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) % 8).any() or column.null_count else _data_of(column)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(raw, "<f8")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(pc.is_valid(column), made, pa.scalar(None, made.type))], names=[*batch.schema.names, name])

    return rows.mapInArrow(of, StructType(list(rows.schema.fields)).add(name, ArrayType(DoubleType())))


def _data_of(column: pa.Array) -> bytes:
    """The bytes of all values of a binary column without nulls, one after the other."""
    _, index, data = column.buffers()
    ends = np.frombuffer(index, np.int32)[column.offset : column.offset + len(column) + 1]
    return data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""


def recency_bonus(created: Column, now: Column) -> Column:
    """1 / log2(age in days + 1), ages under a day counting as one."""
    return 1 / F.log2(F.greatest(F.lit(1.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000) + 1)
