import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.quality import RULES, Cascade, Texts, base_figures, quality
from tests.conftest import SF


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "\n\na\n\na\n", "é€😀 x\x0by\x0cz", "# * $ % & | < >", "w " * 20_000, " ".join(f"u{i}" for i in range(30_000))]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "c", "dd", "é", "#", " ", " ", " ", "\n", "\t", "\r"]) for _ in range(rng.randint(0, 400))))
    return out


def test_base_figures_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality(df, order=[r.name for r in RULES]).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)


def test_the_order_never_changes_a_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [r.name for r in RULES]
    ways = [quality(docs, order=names), quality(docs, order=names[::-1]), quality(docs, sample=20), quality(docs, sample=10**6)]
    verdicts = [{(r.doc_id, r.kept) for r in way.collect()} for way in ways]
    assert all(v == verdicts[0] for v in verdicts)


def batch(texts):
    raw = [x.encode() for x in texts]
    t = Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return t, base_figures(t)


def test_rules_are_ordered_by_rejections_per_second():
    shouts = [" ".join(f"NO{i}!!" for i in range(60))] * 30 + [" ".join(f"fine{i}" for i in range(60))] * 30
    c = Cascade(RULES, 50)
    kept = c.kept(*batch(shouts))
    assert kept.tolist() == [False] * 30 + [True] * 30 and c.seen == 60
    assert {r.name for r in c.rules[:3]} == {"capitals", "exclaims", "few_letters"} and len(c.rules) == len(RULES)
    assert c.kept(*batch(shouts[::-1])).tolist() == [True] * 30 + [False] * 30 and c.seen == 60


def test_a_verdict_never_depends_on_the_text_before():
    shout = " ".join(f"a{i} !" for i in range(40))
    rule = next(r for r in RULES if r.name == "exclaims")
    for before in ("", "x!", "!"):
        t, b = batch([before, "! " + shout])
        assert not rule.rejects(t, b)[1]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_lines_with_structure_differ(spark, n):
    a, b = thue_morse(n)
    text = f"{a}\n{b}\n" + f"{a} {b} {a}\n{b} {a} {b}\n{a}"
    row = quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == plain(text)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_against_labels(spark, sf):
    folder = SF.replace("sf0.001", sf)
    rows = quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert quality(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).where("kept").count() == 0


def test_columns_of_the_result_cannot_be_carried(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_words long")
    with pytest.raises(ValueError, match="n_words"):
        quality(docs, carry=["n_words"])
    assert quality(docs).first().n_words == 2
