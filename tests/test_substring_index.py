import random

import pyarrow as pa

from quarry.operators import blocks
from quarry.operators.keyword_index import KeywordIndex
from quarry.operators.substring_index import containing, put_texts, token_matches

TEXTS = "k int, content string"


def test_any_part_is_found(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abcA .É") for _ in range(rng.randrange(0, 12))) for i in range(80)} | {90: None, 91: "", 92: "straße\nNEUE Zeile", 93: "a" * 5000, 94: "😀😀x"}
    rows = spark.createDataFrame(list(texts.items()), TEXTS)
    index = put_texts(KeywordIndex(spark, str(tmp_path / "ix"), ("k",)), rows, "content")
    asked = ["a", "ab", "abc", "A .", "é", "b É".lower(), "straße\nn", "aaaa", "zzz", "", None, "😀", "😀x", "￿"] + [t[1:6] for t in texts.values() if t and len(t) > 6][:20]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = sorted((r.query_id, r.k) for r in containing(index, rows, queries, "content").collect())
    want = sorted((i, k) for i, q in enumerate(asked) if q is not None for k, t in texts.items() if q == "" or (t is not None and q != "￿" and q.lower() in t.lower()))
    assert got == want


def test_texts_change(spark, tmp_path):
    index = put_texts(KeywordIndex(spark, str(tmp_path / "ix"), ("k",)), spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alphabet")], TEXTS), "content")
    now = spark.createDataFrame([(1, "gamma"), (3, "alphabet")], TEXTS)
    put_texts(index, now.where("k = 1"), "content", deleted=spark.createDataFrame([(2,)], "k int"))
    queries = spark.createDataFrame([(q, q) for q in ("alpha", "bet", "gam", "a", "mm")], "query_id string, text string")
    want = {("alpha", 3), ("bet", 3), ("gam", 1), ("a", 1), ("a", 3), ("mm", 1)}
    assert {(r.query_id, r.k) for r in containing(index, now, queries, "content").collect()} == want
    assert {(r.query_id, r.k) for r in containing(index.compacted(), now, queries, "content").collect()} == want


def test_what_trigrams_leave_stays_in_its_task(spark, tmp_path):
    """No list of a trigram's rows is dealt out for each question; a question of several texts finds a row once."""
    rows = spark.createDataFrame([(i, f"the same words {i}") for i in range(50)], TEXTS)
    index = put_texts(KeywordIndex(spark, str(tmp_path / "ix"), ("k",)), rows, "content")
    queries = spark.createDataFrame([(1, "same"), (1, "words"), (1, "e"), (2, "words 7"), (3, ""), (3, "same")], "query_id int, text string")
    found = containing(index, rows, queries, "content")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in plan and "Generate" not in plan
    got = sorted((r.query_id, r.k) for r in found.collect())
    assert got == sorted([(1, i) for i in range(50)] + [(2, 7)] + [(3, i) for i in range(50)])


def test_words_are_looked_up_by_tokens_not_by_question_and_block(spark, tmp_path):
    """White space, length and several texts of a question decide which way it goes; the ways agree with a plain search."""
    texts = {0: "An\x0bunder-\x1fstated Überfluß", 1: "x" * 40 + " y", 2: None, 3: "", 4: "a b aa\tAAA", 5: "İi ıI 😀x"}
    rows = spark.createDataFrame(list(texts.items()), TEXTS)
    index = put_texts(KeywordIndex(spark, str(tmp_path / "ix"), ("k",)), rows, "content")
    asked = [(0, "R-\x1fS"), (1, "a b"), (2, "x" * 32), (3, "x" * 33), (4, "b a"), (5, "aa"), (5, "aaa"), (6, "y"), (6, "x y"), (7, "rfluß"), (8, "😀"), (9, "n\x0bu"), (10, "stated ")]
    got = sorted((r.query_id, r.k) for r in containing(index, rows, spark.createDataFrame(asked, "query_id int, text string"), "content").collect())
    assert got == sorted({(i, k) for i, q in asked for k, t in texts.items() if t and q.lower() in t.lower()})
    tokens, words = (blocks.words_of(pa.array(x)) for x in ([["abab", "b"], ["ba"], []], [["a"], ["ab", "ba"], ["b"], ["c"]]))
    for entries in (1, 2, 1 << 22):
        found = [(int(q), int(d)) for qs, ds in token_matches(tokens, words, 3, entries) for q, d in zip(qs, ds, strict=True)]
        assert found == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
