import random
import re

import numpy as np
import pytest

from quarry.llm.near_dedup import NearDedup, components, near_duplicates
from tests.llm.test_quality import thue_morse


def plain(docs, words=5, similar=85):
    """(doc_id, set size, component) by brute force."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def texts(seed=1):
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows = [None, "", "  \n", "one two", "ONE two", "a b c d e", "A b\tc d\ne", "a b c d e f", "É é", "é é"]
    for _ in range(12):
        base = make(rng.randint(30, 200))
        rows += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 2, 3, 4)]
    base = make(150)  # a family that goes on and on from copy to copy, and one of copies of one text
    for _ in range(60):
        base = edited(rng, base, 1)
        rows.append(" ".join(base))
    base = make(120)
    rows += [" ".join(edited(rng, base, rng.randint(0, 4))) for _ in range(80)]
    rows.append(" ".join(make(30000)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("p", [NearDedup(), NearDedup(listed=1, block_rows=16), NearDedup(listed=10**6)])
def test_equals_brute_force(spark, p):
    rows = texts()
    df = spark.createDataFrame([(i, t, i, None) for i, t in rows], "doc_id long, text string, component_id long, key string")
    got = near_duplicates(df, p).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(3, "a b"), (3, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 1), (3, 1)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    random.Random(2).shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 160))


def test_the_signature_distance_rarely_passes_its_bound():
    p = NearDedup()
    rng = np.random.default_rng(0)
    assert (rng.binomial(p.symbols, 0.15, 1_000_000) > p.most).mean() < 1e-5
    assert (rng.binomial(p.symbols, 0.20, 1_000_000) > p.most).mean() < 1e-3


def test_rows_without_an_id_or_with_a_shared_one(spark):
    df = spark.createDataFrame([(None, "a b"), (2, "a b"), (None, "c d"), (5, "e f"), (5, "g h"), (5, "g h")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, False), (2, 2, True), (None, None, True), (5, 5, True), (5, 5, True), (5, 5, False)], key=repr)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_structure_are_no_copies(spark, n):
    rows = [(i, f"{w} {w} one two three") for i, w in enumerate(thue_morse(n))]
    assert {r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1}


def test_a_large_group_takes_no_blocks(spark):
    """A group of copies of one text is connected by its leaders; only what they leave is compared in blocks."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(300)] + [(1000 + i, " ".join(edited(rng, base, 18))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, NearDedup(block_rows=32)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == plain(rows)
