"""Exact search with very many query vectors, pruned by pivots.

A few vectors serve as pivots. Each row belongs to the cell of the pivot at the smallest angle, and in it to a ring of such angles; a unit is a ring
of a cell of a group. By the triangle inequality a query can't come nearer to a row of a unit than its own angle to the pivot is outside the
unit's range of angles. With the units' largest lengths that bounds every product of a query with a unit's rows. Each query is compared with its
most promising unit first, which gives its k-th best product so far; then with the units whose bound beats the threshold and reaches that.
Other pairs of units and queries are never formed.

Units meet their queries by an equi-join. Rows and queries of a unit come in blocks of bounded size, dealt by ranges, so a unit with very many rows
is in many tasks; a pair of blocks is one product of matrices, of which each query's best rows go on. Pivots only decide what is skipped, never
the result: no pivot fits vectors of another dimension, which form a cell that is always compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.retrieval import best_of
from quarry.storage import kept

UNIT = ["g", "cell", "ring"]
SLACK = 1e-9  # on bounds, for rounding


@dataclass(frozen=True)
class Pivots:
    """How many pivots, the width of a ring (radians), and the most rows and queries of a block."""

    count: int = 64
    ring: float = 0.05
    rows: int = 4096
    queries: int = 1024


def vectors_of(rows: DataFrame, key: str, vector: str, group: str | None) -> DataFrame:
    """(id, g, v): keys, groups (0 without, -1 for none) and vectors as doubles; rows without a vector are left out."""
    label = F.coalesce(F.col(group).cast("long"), F.lit(-1)) if group else F.lit(0).cast("long")
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), label.alias("g"), F.col(vector).cast("array<double>").alias("v"))


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column by dimension: their rows, and a matrix."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.ascontiguousarray(flat[(ends[at] - ends[0])[:, None] + np.arange(n)], "<f8")


def angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors to unit pivots (a zero vector is at a right angle to all), and the vectors' lengths."""
    length = np.sqrt((x * x).sum(axis=1))
    unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
    return np.arccos(np.clip(unit @ pivots.T, -1, 1)), length


def chosen_pivots(rows: DataFrame, p: Pivots) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the numbers and unit vectors of ``p.count`` pivots in all: the rows with the smallest hashes of their ids."""
    found = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(p.count).collect()]
    out: dict[int, tuple[list, list]] = {}
    for n, v in enumerate(found):
        length = np.sqrt(v @ v)
        if np.isfinite(length) and length > 0:
            out.setdefault(len(v), ([], []))[0].append(n)
            out[len(v)][1].append(v / length)
    return {d: (np.array(n), np.array(v)) for d, (n, v) in out.items()}


def cells(rows: DataFrame, pivots: dict, p: Pivots) -> DataFrame:
    """(id, g, cell, ring, angle, length, n, m): each row's unit, with its vector as bytes; cell -1 where no pivot has its dimension."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_dimension(batch.column("v")):
                cell, angle, length = np.full(len(at), -1), np.zeros(len(at)), np.sqrt((x * x).sum(axis=1))
                if x.shape[1] in pivots:
                    numbers, units = pivots[x.shape[1]]
                    far, length = angles(x, units)
                    best = far.argmin(axis=1)
                    cell, angle = numbers[best], far[np.arange(len(at)), best]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("g").take(take), pa.array(cell, pa.int32()), pa.array(np.floor(angle / p.ring).astype(np.int32)), pa.array(angle), pa.array(length), pa.array(np.full(len(at), x.shape[1]), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["id", "g", "cell", "ring", "angle", "length", "n", "m"],
                )

    return rows.mapInArrow(of, "id long, g long, cell int, ring int, angle double, length double, n int, m binary")


def query_angles(queries: DataFrame, pivots: dict) -> DataFrame:
    """(query, g, cell, angle, length): the angle of each query to each pivot of its dimension; and the cell -1, at angle 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_dimension(batch.column("v")):
                numbers, units = pivots.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1]))))
                far, length = angles(x, units)
                far, every = np.concatenate((far, np.zeros((len(at), 1))), axis=1), np.append(numbers, -1)
                row = pa.array(np.repeat(at, len(every)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("g").take(row), pa.array(np.tile(every, len(at)), pa.int32()), pa.array(far.reshape(-1)), pa.array(np.repeat(length, len(every)))], names=["query", "g", "cell", "angle", "length"])

    return queries.mapInArrow(of, "query long, g long, cell int, angle double, length double")


def packed(rows: DataFrame, order: list[str], most: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of at most ``most`` rows (unit, id, n, m) of one unit and dimension: (unit, n, ids, matrix). A large unit is dealt over several tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy() for c in (*UNIT, "n")], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]).any(axis=1)))) if len(unit) else []
            for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
                for i in range(a, b, most):
                    j = min(b, i + most)
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).slice(0, 1) for c in (*UNIT, "n")), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part.column("m").to_pylist())], pa.binary())],
                        names=[*UNIT, "n", *names],
                    )

    dealt = rows.select(*UNIT, "id", "n", "m").repartitionByRange(*order).sortWithinPartitions(*UNIT, "n", "id")
    return dealt.mapInArrow(of, f"g long, cell int, ring int, n int, {names[0]} array<long>, {names[1]} binary")


def best_products(blocks: DataFrame, asked: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query, id, score): of each pair of blocks of one unit each query's ``k`` best rows above the threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                keys, ids = (one.column(c).flatten().to_numpy() for c in ("ids", "queries"))
                x, q = (np.frombuffer(one.column(c)[0].as_buffer(), "<f8").reshape(-1, one.column("n")[0].as_py()) for c in ("matrix", "query_matrix"))
                order = np.argsort(keys, kind="stable")
                s = q @ x[order].T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(ids)), best.shape[1]), best.reshape(-1)
                good = s[i, j] > threshold
                i, j = i[good], j[good]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(keys[order][j]), pa.array(s[i, j])], names=["query", "id", "score"])

    return blocks.join(asked, [*UNIT, "n"]).select("n", "ids", "matrix", "queries", "query_matrix").mapInArrow(of, "query long, id long, score double")


def promising(rows: DataFrame, queries: DataFrame, pivots: dict) -> DataFrame:
    """(query, unit, bound, rows): for each query the units of its group with a bound on its products with their rows. ``rows`` is that of ``cells``."""
    units = rows.groupBy(*UNIT).agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.max("length").alias("longest"), F.count(F.lit(1)).alias("rows"))
    met = query_angles(queries, pivots).join(units, ["g", "cell"])
    outside = F.greatest(F.lit(0.0), F.col("angle") - F.col("most"), F.col("least") - F.col("angle"))
    bound = F.when(F.col("cell") < 0, F.lit(1.0)).otherwise(F.cos(outside)) * F.col("length") * F.col("longest")
    # a negative cosine bounds best by the smallest length, which isn't kept: 0 is a bound too
    return met.select("query", *UNIT, (F.greatest(bound, F.lit(0.0)) + SLACK).alias("bound"), "rows")


def searched(rows: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, threshold: float, vector: str, group: str | None, p: Pivots) -> tuple[DataFrame, DataFrame]:
    """The best rows (query_id, key, score), and the pairs of queries and units that were compared: (query, unit, bound, rows)."""
    base = vectors_of(rows, key, vector, group)
    pivots = chosen_pivots(base, p)
    placed = kept(cells(base, pivots, p), "vector-cells")
    asked = vectors_of(queries, query_key, vector, group)
    blocks = kept(packed(placed, [*UNIT, "n", "id"], p.rows, ("ids", "matrix")), "vector-blocks")
    bytes_of = cells(asked, {}, p).select(F.col("id").alias("query"), "n", "m")

    def compared(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("query", *UNIT).join(bytes_of, "query").withColumnRenamed("query", "id")
        return best_products(blocks, packed(rows, [*UNIT, "n", "id"], p.queries, ("queries", "query_matrix")), k, threshold)

    first = F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), *UNIT)) == 1
    ranked = kept(promising(placed, asked, pivots).where(F.col("bound") > threshold).withColumn("first", first), "promising-units")
    begun = kept(best_of(compared(ranked.where("first")), "query", "id", k), "first-products")
    so_far = begun.groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("kth")).where(F.col("found") >= k).drop("found")
    more = ranked.where("not first").join(so_far, "query", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("query", *UNIT, "bound", "rows")
    best = best_of(begun.union(compared(more)), "query", "id", k)
    return best.select(F.col("query").alias("query_id"), F.col("id").alias(key), "score"), ranked.where("first").select("query", *UNIT, "bound", "rows").union(more)


def vector_search(rows: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 3, threshold: float = 0.3, vector: str = "embedding", group: str | None = None, p: Pivots = Pivots()) -> DataFrame:
    """(query_id, key, score): for each of many query vectors the ``k`` most similar rows above the threshold (0 or more), within its group if one is given.

    Exact; ties go to the smaller key. Vectors of another dimension than the query's don't count. Query keys are unique.
    """
    if threshold < 0:
        raise ValueError("the threshold must be 0 or more")
    return searched(rows, queries, key, query_key, k, threshold, vector, group, p)[0]


def compared_share(rows: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 3, threshold: float = 0.3, vector: str = "embedding", group: str | None = None, p: Pivots = Pivots()) -> DataFrame:
    """(pairs, compared, skipped): how many pairs of a query and a row of its group there are, how many were compared, and the share that wasn't."""
    used = searched(rows, queries, key, query_key, k, threshold, vector, group, p)[1].agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("compared"))
    sizes = vectors_of(rows, key, vector, group).groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    all_ = vectors_of(queries, query_key, vector, group).groupBy("g").agg(F.count(F.lit(1)).alias("queries")).join(sizes, "g").agg(F.coalesce(F.sum(F.col("rows") * F.col("queries")), F.lit(0)).alias("pairs"))
    return all_.crossJoin(F.broadcast(used)).select("pairs", "compared", (1 - F.col("compared") / F.greatest("pairs", F.lit(1))).alias("skipped"))
