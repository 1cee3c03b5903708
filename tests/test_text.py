import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_tokenize_examples(spark):
    words = one(spark, "The quick brown fox jumps over the lazy dog", T.tokenize)
    assert {"quick", "brown", "fox", "jumps", "lazy", "dog"} <= set(words) and "the" not in words
    assert one(spark, "", T.tokenize) == [] and one(spark, None, T.tokenize) == []
    assert one(spark, "the is a an of", T.tokenize) == []
    assert set(one(spark, "Swift CODING MacOS", T.tokenize)) == {"swift", "coding", "macos"}
    assert set(one(spark, "hello-world! foo_bar, baz.qux", T.tokenize)) == {"hello", "world", "foo", "bar", "baz", "qux"}


@pytest.mark.parametrize(
    ("text", "k", "expected"),
    [("swift swift swift coding coding testing", 3, ["swift", "coding", "testing"]), ("", 5, []), ("banana apple cherry", 3, ["apple", "banana", "cherry"]), ("alpha beta gamma delta epsilon", 2, ["alpha", "beta"])],
)
def test_keywords(spark, text, k, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert T.top_keywords(df, ["id"], "t", k).first()["keywords"] == expected


def test_strip_html_edges(spark):
    assert one(spark, "a &amp;lt; b", T.strip_html) == "a < b"
    assert one(spark, "<pre>x</pre><PRE>y</PRE>", T.strip_html) == "x y"
    assert one(spark, "<STYLE>p{}</STYLE><style>q{}</style>", T.strip_html) == "p{}"
    assert one(spark, "<script>var a = 1;", T.strip_html) == "var a = 1;"
    assert one(spark, "<p>a</p>\n\n\n <p>b</p>", T.strip_html) == "a \n\nb".replace(" \n", "\n")


def test_fact_lines(spark):
    df = spark.createDataFrame([(1, "[Swift, iOS] likes it\nNONE\n\n[] empty\n[a]\nplain words here\nto of"), (2, None)], "id int, t string")
    rows = {r.line: (r.content, r.keywords) for r in T.fact_lines(df, "id", "t").collect()}
    assert rows == {0: ("likes it", ["swift", "ios"]), 5: ("plain words here", ["here", "plain", "words"])}


def test_titles_and_tool_names(spark):
    assert one(spark, "x" * 31, T.auto_title) == "x" * 30 + "..." and one(spark, "x" * 30, T.auto_title) == "x" * 30
    assert one(spark, "My Tool-1 é!", T.tool_name) == "my_tool1_é"
