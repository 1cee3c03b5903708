import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm.sharding import cuts, sharded


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, load = (low + high) // 2, 1, 0
        for x in sizes:
            if load + x > mid:
                n, load = n + 1, 0
            load += x
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("n", "shards"), [(1, 3), (5, 24), (50, 4), (400, 24)])
def test_cuts_are_minimax(spark, n, shards):
    rng = random.Random(n)
    sizes = [rng.choice([1, 5, 20, 400]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "unit int, size long")
    firsts = cuts(df, shards)
    assert len(firsts) < shards
    bounds = [0, *firsts, n]
    assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) == least_capacity(sizes, shards)


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300))), "x") for i in range(1500)] + [(5000 + i, "one hot text", "x") for i in range(900)] + [(9000, None, "x"), (9001, "", "x"), (9002, "é" * 5000, "x"), (9002, "é" * 5000, "x")]
    got = sharded(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {i: t or "" for i, t, _ in rows}
    by, groups, sizes = {}, {}, {}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(raw, set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(g) == 1 for g in groups.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + max(900 * 20, 10_008)
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_equal_a_plain_filling(spark):
    """Groups in the order of their hashes fill shards up to the smallest capacity, one after the other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = {r.doc_id: (r.u, r.n) for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 49).alias("u"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("n")).collect()}
    sizes = {}
    for u, n in units.values():
        sizes[u] = sizes.get(u, 0) + n
    order = sorted(sizes)
    capacity, shard, load, where = least_capacity([sizes[u] for u in order], 24), 0, 0, {}
    for u in order:
        if load + sizes[u] > capacity:
            shard, load = shard + 1, 0
        load += sizes[u]
        where[u] = shard
    assert {r.doc_id: r.shard for r in sharded(docs).collect()} == {i: where[u] for i, (u, _) in units.items()}
