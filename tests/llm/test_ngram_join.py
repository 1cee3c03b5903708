import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import ngram_join as J
from quarry.llm.common import cut


def shingles(text, words=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else ({tuple(ws)} if ws else set())


def brute(rows, p):
    """The same by comparing all pairs."""
    sets, root = [shingles(t, p.words) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= p.similar * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda r: (rows[r][0], r))] = min(x, y, key=lambda r: (rows[r][0], r))
    return sorted((i, len(s), rows[find(k)][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def answer(spark, rows, p, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in J.ngram_components(spark.createDataFrame(rows, schema).repartition(3), p).collect())


def words(rng, n, vocabulary=200):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


def corpus(rng, groups=12, copies=6, size=(5, 120), edits=2):
    rows = []
    for _ in range(groups):
        base = words(rng, rng.integers(*size))
        for _ in range(rng.integers(1, copies + 1)):
            text = list(base)
            for _ in range(rng.integers(0, edits + 1)):
                text[rng.integers(len(text))] = f"x{rng.integers(50)}"
            rows.append(" ".join(text))
    return list(enumerate(rng.permutation(np.array(rows, object)).tolist()))


@pytest.mark.parametrize("p", [J.NgramJoin(listed=2, block_rows=4), J.NgramJoin(similar=70, listed=3)], ids=str)
def test_components_equal_brute_force(spark, p):
    rows = corpus(np.random.default_rng(11))
    assert answer(spark, rows, p) == brute(rows, p)


def test_near_copies_in_a_row_are_all_found(spark):
    """Each text is similar to its neighbours only; the leader reaches few of them."""
    rng = np.random.default_rng(2)
    text, rows = words(rng, 300), []
    for i in range(60):
        text = list(text)
        text[(i * 5) % 300] = f"new{i}"
        rows.append((i, " ".join(text)))
    got = answer(spark, rows, J.NgramJoin(listed=2, block_rows=8))
    assert got == brute(rows, J.NgramJoin()) and {r[2] for r in got} == {0}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(9, 400), st.sampled_from([70, 80, 90, 95]), st.integers(0, 4))
def test_similar_sets_share_a_key_under_any_allocation(seed, n, similar, skipped):
    rng = np.random.default_rng(seed)
    p = J.NgramJoin(similar=similar)
    low, segs = J.bands(p)
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    keep = int(rng.integers(n * similar // 100, n + 1))
    b = np.concatenate((a[:keep], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)))
    if 100 * keep < similar * (len(a) + len(b) - keep):
        return
    a, b = sorted((a, b), key=len)  # b looks among sets of a's band
    band = J.band_of(np.array([len(a)]), low)
    assert J.band_of(np.array([len(b)]), low)[0] - band[0] in (0, 1)
    count = segs[band]
    if not count[0]:
        assert len(a) == len(b) == keep
        return
    sides = [J.segments(x, np.zeros(len(x), np.int64), band, count) for x in (a, b)]
    whole = [set(J.whole_key(s[2], s[3]).tolist()) for s in sides]
    assert whole[0] & whole[1]
    slot, add, sums, salt, n_in = sides[1]
    skip = list(range(min(skipped, count[0] // 2)))
    some = [j for j in range(count[0]) if j not in skip][: len(skip)]
    stay = {int(k) for j, k in enumerate(J.whole_key(sums, salt).tolist()) if j not in skip}
    less_a = set(J.less_key(sides[0][2][sides[0][0]] - sides[0][1], sides[0][3][sides[0][0]]).tolist())
    one = np.isin(slot, some)
    looked = set(J.whole_key(sums[slot[one]] - add[one], salt[slot[one]]).tolist())
    assert stay & whole[0] or looked & whole[0] or set(J.less_key(sums[some], salt[some]).tolist()) & less_a


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 300), st.integers(0, 300))
def test_sketches_never_differ_more_than_the_sets(seed, m, n, both):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**63, min(both, m, n)).astype(np.uint64)
    a, b = (np.concatenate((common, rng.integers(0, 2**63, k - len(common)).astype(np.uint64))) for k in (m, n))
    x, y = J.matrix([J.sketch(a)]), J.matrix([J.sketch(b)])
    w = min(x.shape[1], y.shape[1])
    assert np.bitwise_count(J.folded(x, w) ^ J.folded(y, w)).sum() <= m + n - 2 * len(common)


def test_common_subsets_are_skipped_where_it_pays(spark):
    """Texts that share a passage and differ else: common segments are given up, and pairs that only meet there are found by deletions."""
    rng = np.random.default_rng(8)
    passage, rows = words(rng, 14, 9), []
    for i in range(40):
        own = [f"own{i}a", f"own{i}b"]
        rows.append(" ".join(passage + own))
        rows.append(" ".join(passage + own[:1]))  # without the last shingle
    rows = list(enumerate(rows))
    p = J.NgramJoin(listed=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = cut(docs.select(docs.doc_id.alias("rep")), "t")
    table = cut(J.filed(docs, base, p), "t")
    q = J.NgramJoin(listed=3, most_found=1000)
    keys = table.select("rep", F.col("n_shingles").alias("n"), F.lit(True).alias("own"), F.posexplode("own").alias("j", "key"))
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("rep").alias("least")).where("sets > 3")
    common = cut(keys.join(many, "key"), "t")
    left, pairs = J.reallocated(common, table, docs, q)
    assert left.select("key").distinct().count() < many.count() and pairs.count() > 0
    assert answer(spark, rows, q) == brute(rows, q)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    p = J.NgramJoin()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "a b c d"), (9, "a b c d"), (9, "a b c d"), (10, "É é x"), (11, "é é x")]
    assert answer(spark, [r for r in rows if r != (9, "a b c d")] + [(9, "a b c d")], p) == brute([r for r in rows if r != (9, "a b c d")] + [(9, "a b c d")], p)
    out = J.ngram_components(spark.createDataFrame([(*r, "k", 5, 6) for r in rows], "doc_id long, text string, rep string, n_shingles int, named int"), p)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 2, 8), (9, 2, 8), (9, 2, 8), (10, 1, 10), (11, 1, 11)]
    nameless = J.ngram_components(spark.createDataFrame([(None, "x y z"), (None, "x y z"), (3, "x y z w v")], "doc_id long, text string"), p)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in nameless.collect()) == [("3", 3, 3), ("None", 1, None), ("None", 1, None)]
    assert answer(spark, [], p) == []


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    a = words(rng, 60_000, 10**6)
    b = list(a)
    b[::400] = ["new"] * len(b[::400])
    c = list(a)
    c[::40] = ["new"] * len(c[::40])
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "z" * 500_000)]
    assert answer(spark, rows, J.NgramJoin()) == brute(rows, J.NgramJoin())


def test_many_copies_of_one_text(spark):
    rng = np.random.default_rng(6)
    base = words(rng, 200)
    rows = []
    for i in range(600):
        text = list(base)
        if i % 2:
            text[rng.integers(200)] = f"y{i}"
            text[rng.integers(200)] = f"z{i}"
        rows.append((i, " ".join(text)))
    p = J.NgramJoin(block_rows=64)
    assert answer(spark, rows, p) == brute(rows, p)
