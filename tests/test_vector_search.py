import random

import numpy as np
import pytest

from quarry.operators.vector_search import Pivots, compared_share, searched, vector_search
from quarry.plans import queries
from tests.conftest import SF


def brute(rows, asked, k, threshold, group):
    out = []
    for i, q, g in asked:
        scored = [(sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v, h in rows if v and q and len(v) == len(q) and (not group or (g if g is not None else -1) == (h if h is not None else -1))]
        out += [(i, j) for s, j in sorted((x for x in scored if x[0] > threshold), key=lambda x: (-round(x[0], 9), x[1]))[:k]]
    return sorted(out)


@pytest.mark.parametrize(("group", "p"), [(None, Pivots(5, 0.1, 16, 8)), ("g", Pivots(9, 0.3, 7, 5))])
def test_equals_brute_force(spark, group, p):
    rng = random.Random(21)
    unit = lambda n=3: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, unit() if i % 11 else None, i % 3 if i % 13 else None) for i in range(150)] + [(500, [1.0, 2.0], 0), (501, [0.0, 0.0, 0.0], 0), (502, [], 0), (503, [2.0, 1.0], 0)]
    rows += [(600 + i, rows[1][1], 1) for i in range(5)]  # ties
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g int")
    asked = [r for r in rows if r[0] % 5 == 0 or r[0] in (1, 501, 503)]
    got = vector_search(df.repartition(5), spark.createDataFrame(asked, df.schema), "id", "id", 4, group=group, p=p).collect()
    ids = [tuple(r)[:2] for r in got]
    assert sorted(ids) == brute(rows, asked, 4, 0.3, group)


def test_pairs_of_far_units_are_never_formed(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = []
    for i in range(800):
        v = centres[i % 16] + rng.normal(size=16) * 0.03
        rows.append((i, (v / np.linalg.norm(v)).tolist(), 0))
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g int")
    asked = df.where("id % 40 < 4")
    share = compared_share(df, asked, "id", "id", 3, p=Pivots(32, 0.05)).first()
    assert share.pairs == 800 * 80 and share.skipped > 0.8 and share.compared < share.pairs / 5
    got = sorted(tuple(r)[:2] for r in vector_search(df, asked, "id", "id", 3, p=Pivots(32, 0.05)).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 40 < 4], 3, 0.3, None)


def test_plans_have_no_cross_join_of_blocks(spark):
    for name in ("vector_search", "vector_search_by_domain"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_no_rows_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0)], "id long, embedding array<double>, g int")
    assert vector_search(df.limit(0), df, "id", "id").count() == 0 and vector_search(df, df.limit(0), "id", "id").count() == 0
    best, pairs = searched(df, df, "id", "id", 1, 0.3, "embedding", None, Pivots())
    assert [tuple(r) for r in best.collect()] == [(1, 1, 1.0)] and pairs.count() == 1
    with pytest.raises(ValueError, match="threshold"):
        vector_search(df, df, "id", "id", threshold=-0.5)
