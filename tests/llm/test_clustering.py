import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.clustering import Clustering, clusters, nearest


def brute(rows, p):
    """The same, vector by vector."""
    kept = [(i, [int(np.floor(p.scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == p.dims and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{p.seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in by_hash[: p.k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(p.rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    per = [sum(s for s, m in found if m == n) for n in range(len(centroids))]
    return sorted((str(i), n, s, per[n], sum(per), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (s, n) in zip(kept, found, strict=True))


def answer(spark, rows, p, schema="vec_id long, embedding array<float>"):
    out = clusters(spark.createDataFrame(rows, schema).repartition(3), p)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.integers(0, 2**32 - 1))
def test_threshold_walk_finds_the_nearest(k, dims, seed):
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-4, 5, (50, dims)), rng.integers(-4, 5, (k, dims))
    who, best, steps = nearest(v, c)
    exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (who == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and (steps <= k).all()


def test_walks_stop_early():
    c = np.arange(64)[:, None] * np.full((1, 4), 1000)
    _, _, steps = nearest(c + 3, c)
    assert steps.max() <= 2


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    p = Clustering(dims=6, k=5, rounds=4, scale=16)
    rows = [(i, (rng.normal(size=6) + (i % 4)).astype(np.float32).tolist()) for i in range(400)]
    assert answer(spark, rows, p) == brute(rows, p)


def test_nulls_odd_vectors_ties_and_repeats(spark):
    p = Clustering(dims=2, k=3, rounds=3, scale=4)
    rows = [(1, [0.1, -0.1]), (1, [0.1, -0.1]), (1, [2.0, 2.0]), (None, [1.0, 1.0]), (None, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [-5.0, 3.0]), (8, [1.0, 1.0, 1.0])]
    assert answer(spark, rows, p) == brute(rows, p) and len(brute(rows, p)) == 5


def test_fewer_vectors_than_centroids_and_none(spark):
    p = Clustering(dims=1, k=8, rounds=2)
    assert answer(spark, [(1, [0.5]), (2, [0.25])], p) == brute([(1, [0.5]), (2, [0.25])], p)
    assert answer(spark, [], p) == [] and answer(spark, [(1, None)], p) == []


def test_other_columns_and_large_values(spark):
    p = Clustering(dims=1, k=2, rounds=1)
    rows = spark.createDataFrame([(1, [1.0], "x", 3), (2, [2.0], "y", 4)], "vec_id long, embedding array<double>, cluster string, v int")
    assert clusters(rows, p).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and clusters(rows, p).count() == 2
    with pytest.raises(Exception, match="must stay within"):
        clusters(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), p)


def test_long_vectors(spark):
    p = Clustering(dims=50_000, k=2, rounds=1)
    rows = [(i, [float(i)] * 50_000) for i in range(3)]
    assert answer(spark, rows, p) == brute(rows, p)
