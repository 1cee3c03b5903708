import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.memory import add_all, memory_log, repaired, span_heads


def fold(rows, capacity):
    out = []
    for log in {r[0] for r in rows}:
        mine = sorted({(s, c) for x, s, c in rows if x == log and c is not None and c.strip()})
        out += [(str(log), s, c) for s, c in add_all([], iter(mine), capacity)]
    return sorted(out)


def replay(spark, rows, capacity, **how):
    df = spark.createDataFrame(rows, "log string, seq long, content string")
    return sorted((str(r.log), r.seq, r.content) for r in memory_log(df, capacity, **how).collect())


@pytest.mark.parametrize(("capacity", "head", "kinds"), [(3, 1, 4), (3, 4, 5), (5, 7, 40), (10, None, 12)])
def test_equals_the_fold_on_repeats(spark, capacity, head, kinds):
    """Few different contents, so that what is held before a span is refused in it, again and again."""
    rng = random.Random(capacity * kinds)
    rows = [(log, i, f"m{rng.randrange(kinds)}") for log in ("a", "b", None) for i in range(rng.randrange(150, 300))]
    rows += [("c", 1, "only"), ("c", 2, None), ("c", 3, "  \n")]
    assert replay(spark, rows, capacity, head=head, spans=7) == fold(rows, capacity)


def test_spans_that_never_coincide_are_replayed_whole(spark):
    """Contents in turn, one more than fit: each start gives another state for ever."""
    rows = [("a", i, f"m{i % 4}") for i in range(400)]
    assert replay(spark, rows, 3, head=2, spans=5) == fold(rows, 3)
    rows = [("a", 0, "x")] + [("a", i, "yx"[i % 2]) for i in range(1, 200)]
    assert replay(spark, rows, 2, head=1, spans=6) == fold(rows, 2)


def test_an_entry_that_fell_out_comes_again(spark):
    assert replay(spark, [("l", i, c) for i, c in enumerate("ABCA")], 2) == [("l", 2, "C"), ("l", 3, "A")]


def test_only_heads_are_seen_again(spark):
    adds = spark.range(60_000).selectExpr("'l' as log", "id as seq", "cast(xxhash64(id % 7000) as string) as digest")
    heads = span_heads(adds, 100, 1000, spans=8).cache()
    assert heads.count() <= 8 * (1000 + 100) and heads.select("span").distinct().count() == 8
    got = sorted((r.seq, r.digest) for r in repaired(heads, 100).collect())
    assert len(got) == 100 and got == sorted((s, d) for s, d in add_all([], ((r.seq, r.digest) for r in adds.sort("seq").collect()), 100))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(1, 4))
def test_two_simulations_that_hold_the_same_stay_together(before, adds, capacity):
    true, fresh, met = add_all([], ((i, str(c)) for i, c in enumerate(before)), capacity), [], False
    for i, c in enumerate(adds, len(before)):
        true, fresh = add_all(true, iter([(i, str(c))]), capacity), add_all(fresh, iter([(i, str(c))]), capacity)
        met = met or true == fresh
        assert not met or true == fresh
