import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import re

import numpy as np

from quarry.llm.spelling import Spelling, edits, hashes, spelling_variants, word_counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """The same by comparing all words."""
    form = {}
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] is not None else None) for w, n in counts.items())


def brute_counts(rows, typos=None):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos and h % typos == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


def variants(spark, counts, p=Spelling()):
    return rows_of(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), p))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc\u00e9\U0001f600", min_size=1, max_size=6), min_size=1, max_size=5), st.integers(1, 40))
def test_edits_are_the_hashes_of_edited_words(words, tile):
    n = len(words[0])
    words = [(w * n)[:n] for w in words]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
    alphabet = np.unique(np.frombuffer("abcd\u00e9\U0001f600".encode("utf-32-le"), np.uint32))
    seen = []
    for size, line, at, letter, made in edits(points, alphabet, tile):
        for k in range(len(line)):
            w = words[line[k]]
            e = w[: at[k]] + ("" if letter is None else chr(letter[k])) + w[at[k] + 1 :]
            assert len(e) == size
            assert made[k] == hashes(np.frombuffer(e.encode("utf-32-le"), np.uint32).reshape(1, len(e)))[0]
            seen.append((int(line[k]), e))
    want = [(i, e) for i, w in enumerate(words) for e in {w[:j] + w[j + 1 :] for j in range(n)} | {w[:j] + chr(c) + w[j + 1 :] for j in range(n) for c in alphabet if chr(c) > w[j]}]
    assert sorted(seen) == sorted(want)


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    counts = {"".join(rng.choice(list("abc"), rng.integers(3, 6))): int(10 ** rng.uniform(0, 4)) for _ in range(250)}
    assert variants(spark, counts) == brute(counts)


def test_many_small_filters_lose_nothing(spark):
    rng = np.random.default_rng(4)
    counts = {"".join(rng.choice(list("xyz\u00e9"), rng.integers(4, 7))): int(10 ** rng.uniform(0, 3)) for _ in range(200)}
    assert variants(spark, counts, Spelling(filter_bytes=100, tile=50)) == brute(counts)


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"aaaaaaa" + "b" * i: 10**i for i in range(8)}
    got = variants(spark, counts)
    assert got == brute(counts) and {r[2] for r in got} == {"aaaaaaabbbbbbb"}


def test_ties_go_to_the_smaller_word_and_the_ratio_is_inclusive(spark):
    counts = {"letters": 100, "lettera": 100, "letter\u00e9": 100, "letterx": 10, "lettery": 11}
    got = {r[0]: r[1] for r in variants(spark, counts)}
    assert got["letterx"] == "lettera" and got["lettery"] is None


def test_counts_of_words_with_typos(spark):
    rng = np.random.default_rng(7)
    words = ["licence", "License", "R\u00c9SUM\u00c9S", "r\u00e9sum\u00e9s", "quarrying", "short", "\u00c0\u00d7\u00f7\u00ff\u0101aaaaaaaa"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words, 40)) + "-x9Quarrying_") for i in range(60)] + [(1, None), (2, ""), (3, "quarrying " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for typos in (None, 31):
        counts = word_counts(docs, typos=typos)
        assert {r.word: r.n for r in counts.collect()} == brute_counts(rows, typos)
    assert rows_of(spelling_variants(counts)) == brute(brute_counts(rows, 31))


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [("spelling", 10, 1), ("spelling", 20, 2), ("speling", 3, 3), (None, 4, 4), ("spellin", None, 5)]
    got = rows_of(spelling_variants(spark.createDataFrame(rows, "word string, n long, form int")))
    assert got == [("speling", "spelling", "spelling", 3, 1, 30), ("spelling", None, "spelling", 30, 1, None)]
    assert rows_of(spelling_variants(spark.createDataFrame([], "word string, n long"))) == []
    assert word_counts(spark.createDataFrame([], "doc_id long, text string, run string, n int, word int")).collect() == []


@pytest.mark.parametrize("length", [40_000])
def test_a_very_long_word(spark, length):
    a = "abcdefghij" * (length // 10)
    counts = {a: 2, a[:-1]: 30, a[:500] + "z" + a[501:]: 3, "a" * length: 2, "a" * (length - 1): 2}
    assert variants(spark, counts) == brute(counts)
