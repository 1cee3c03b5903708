"""Centroid clustering (k-means on whole numbers), each vector's nearest centroid found by the threshold algorithm.

Centroids are few: they travel with the tasks. For each dimension they are a list sorted by value. From a vector's own value each list is
walked outward, nearest value first; a centroid met for the first time gets its exact distance. No centroid that wasn't met can be nearer
than the sum of the lists' frontier distances, so the walk stops when that sum strictly exceeds the best exact distance: on a tie it goes
on, and the smaller number wins. Whole batches of vectors walk at once, and those that are done leave.

A round is one pass over the table: tasks add up their vectors per centroid, sums of tasks are added by Spark, and the driver gets
``k * dims`` numbers. Sums, means and distances are exact whole numbers, so the result doesn't depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond it would give squared distances that a long doesn't hold.
LARGEST = 1 << 27
ROWS = 2048  # vectors that walk at once


@dataclass(frozen=True)
class Clustering:
    dims: int = 64
    k: int = 8
    rounds: int = 10
    scale: int = 1024
    seed: str = "3"


def lattice(column: pa.Array, p: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors that count, and their whole numbers floor(scale * x)."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == p.dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
    x = np.floor(p.scale * flat.astype(np.float64)).reshape(len(at), p.dims)
    good = np.isfinite(x).all(axis=1)
    at, x = at[good], x[good]
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components must stay within {LARGEST} after scaling, or distances don't fit a long")
    return at, x.astype(np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (of equally near ones the first), the squared distance, and the steps walked."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    rim = np.int64(2 * LARGEST + 2)  # farther than any value: the end of a list
    padded = np.vstack((np.full((1, dims), -4 * rim), lists, np.full((1, dims), 4 * rim)))
    ids = np.vstack((np.zeros((1, dims), np.int64), order, np.zeros((1, dims), np.int64)))
    who, best, steps = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    live, d = np.arange(len(v)), np.arange(dims)
    low = np.stack([np.searchsorted(lists[:, j], v[:, j]) for j in range(dims)], axis=1) if len(v) else np.zeros((0, dims), np.int64)
    high, seen = low + 1, np.zeros((len(v), k), bool)
    for _ in range(k):
        x = v[live]
        left, right = x - padded[low, d], padded[high, d] - x
        down = left <= right
        frontier = np.where(down, left, right)
        met = ids[np.where(down, low, high), d]
        low, high = low - down, high + ~down
        new = np.zeros_like(seen)
        new[np.arange(len(live))[:, None], met] = True
        new &= ~seen
        seen |= new
        i, c = np.nonzero(new)
        exact = np.full(seen.shape, np.iinfo(np.int64).max)
        exact[i, c] = ((x[i] - centroids[c]) ** 2).sum(axis=1)
        first = exact.argmin(axis=1)
        least = exact[np.arange(len(live)), first]
        better = (least < best[live]) | ((least == best[live]) & (first < who[live]))
        best[live[better]], who[live[better]] = least[better], first[better]
        steps[live] += 1
        go = (frontier**2).sum(axis=1) <= best[live]
        if not go.any():
            break
        live, low, high, seen = live[go], low[go], high[go], seen[go]
    return who, best, steps


def assigned(batch: pa.RecordBatch, centroids: np.ndarray, p: Clustering) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch that count, their whole numbers, clusters and distances, some rows at a time."""
    at, v = lattice(batch.column("v"), p)
    for i in range(0, len(at), ROWS):
        yield at[i : i + ROWS], v[i : i + ROWS], *nearest(v[i : i + ROWS], centroids)[:2]


def totals(rows: DataFrame, centroids: np.ndarray, p: Clustering) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
    """Counts, summed distances and sums of components of each cluster that has vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, spread, count = np.zeros(centroids.shape, np.int64), [0] * len(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, cluster, distance in assigned(batch, centroids, p):
                for c in np.unique(cluster):
                    mine = cluster == c
                    sums[c] += v[mine].sum(axis=0)
                    spread[c] += int(distance[mine].sum())
                    count[c] += mine.sum()
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([[count[c], spread[c], *sums[c].tolist()] for c in used], pa.list_(pa.int64()))], names=["c", "x"]
        )

    parts = rows.mapInArrow(add, "c int, x array<long>").select("c", F.posexplode("x").alias("i", "x"))
    added: dict[int, list[int]] = {}
    for c, _, x in sorted(parts.groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()):
        added.setdefault(c, []).append(int(x))
    return {c: x[0] for c, x in added.items()}, {c: x[1] for c, x in added.items()}, {c: x[2:] for c, x in added.items()}


def first_centroids(rows: DataFrame, p: Clustering) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in this order (ties, as of repeated ids: by components; no id: last)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = lattice(batch.column("v"), p)
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * p.dims)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))], names=["id", "v"])

    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.mapInArrow(kept, "id long, v array<long>").withColumn("h", digest).orderBy(F.asc_nulls_last("h"), "v").limit(p.k)
    return np.array([r["v"] for r in chosen.collect()], np.int64).reshape(-1, p.dims)


def clusters(vectors: DataFrame, p: Clustering = Clustering(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors of ``p.dims`` finite components.

    Each component counts as floor(scale * x). The centroids begin as the vectors whose ids have the smallest hashes; each round assigns
    all vectors and moves each centroid to the floor of its vectors' exact mean, one without vectors stays. Then all are assigned once more.

    Rows whose vector is null, has another length or a null, NaN or infinite component are left out; with fewer vectors than ``k`` there are
    fewer centroids. Rows that repeat an id, or have none, are vectors of their own; equal vectors have equal answers. Other columns are
    ignored. An empty table gives an empty result. A scaled component beyond 2**27 is an error, as distances wouldn't fit a long.
    The table is read ``rounds + 3`` times, so it should be a stored one.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centroids = first_centroids(rows, p)
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(p.rounds):
        count, _, sums = totals(rows, centroids, p)
        moved = np.array([[s // count[c] for s in sums[c]] if c in count else centroids[c].tolist() for c in range(len(centroids))], np.int64)
        if (moved == centroids).all():
            break  # a further round would change nothing
        centroids = moved
    _, spread, _ = totals(rows, centroids, p)
    inertia, total = np.array([spread.get(c, 0) for c in range(len(centroids))], np.int64), sum(spread.values())
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, cluster, distance in assigned(batch, centroids, p):
                columns = [batch.column("id").take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(inertia[cluster]), pa.array(np.full(len(at), total)), pa.array(digests[cluster], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(answer, schema)


def oracle_sql(p: Clustering = Clustering(), table: str = "embeddings", key: str = "vec_id", vector: str = "embedding") -> str:
    """The same for DuckDB: every round compares all vectors with all centroids."""
    d = p.dims
    square = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT".format(d=d)
    steps = []
    for r in range(p.rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT n, arg_min(c, (s, c)) AS c, min(s) AS s, any_value(v) AS v FROM (SELECT n, v, c, {square} AS s FROM k, (SELECT c, v AS w FROM c{r})) GROUP BY n),\n"
            f"m{r} AS (SELECT c, list((t - ((t % m) + m) % m) // m ORDER BY i)::BIGINT[] AS v FROM (SELECT c, i, sum(v[i]) AS t, count(*) AS m FROM a{r}, range(1, {d} + 1) g(i) GROUP BY ALL) GROUP BY c),\n"
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"
        )
    last = p.rounds
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS n, {key}, list_transform({vector}, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len({vector}) = {d} AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || {key}), v) - 1 AS c, v FROM k ORDER BY c LIMIT {p.k}),
{(',' + chr(10)).join(steps)}
SELECT {key}, a.c::INTEGER AS cluster, a.s AS distance, sum(a.s) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.s) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} a JOIN k USING (n) JOIN c{last} ON c{last}.c = a.c
"""
