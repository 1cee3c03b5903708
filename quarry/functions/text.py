"""Text functions as columns: tokens, keywords, HTML to text, parsers of small notations.

Lengths count code points. Character classes are written out, so that Spark and SQL engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning for search.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can to of in for
on with at by from as into about that this it its and or but not no so if i me my you your we our they them their
what which who how when where why
""".split()

NOT_ALNUM = "[^\\p{L}\\p{M}\\p{N}]+"
SPACE = "[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+"


# The characters that Unicode calls blanks (Zs), and those that count as white space besides.
BLANKS = "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SPACES = BLANKS + "\n\x0b\f\r\x85\u2028\u2029"


def trim_blanks(text: Column) -> Column:
    """Without blanks and tabs at both ends; line breaks stay."""
    return F.btrim(text, F.lit(BLANKS))


def trim_space(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Significant words in order, with repeats: lower case, three characters or more, no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def tokenize(text: Column) -> Column:
    """The distinct significant words."""
    return F.array_distinct(tokens(text))


def keywords_of(text: Column, limit: int = 5) -> Column:
    """The most frequent significant words of a text, by count, then by word; an empty array where there are none.

    In a sorted array a word's run ends where the next word differs; runs are ranked by their lengths. So nothing is shuffled.
    """

    def ranked(words: Column) -> Column:
        ends = F.filter(F.transform(words, lambda w, i: F.when(~w.eqNullSafe(F.get(words, i + 1)), i + 1)), lambda i: i.isNotNull())
        runs = F.zip_with(ends, F.concat(F.array(F.lit(0)), ends), lambda e, b: F.struct((b - e).alias("n"), F.get(words, e - 1).alias("w")))
        return F.transform(F.slice(F.array_sort(F.filter(runs, lambda r: r["n"].isNotNull())), 1, limit), lambda r: r["w"])

    return F.get(F.transform(F.array(F.array_sort(tokens(text))), ranked), F.lit(0))  # the sorted words are made once


def top_keywords(df: DataFrame, keys: list[str], text: str, limit: int = 5, name: str = "keywords") -> DataFrame:
    """(keys, name): the keywords of each row."""
    return df.select(*keys, keywords_of(F.col(text), limit).alias(name))


def keyword_list(text: Column, automatic: Column) -> Column:
    """Keywords typed with commas: trimmed, lower case, none empty; for blank input those found automatically."""
    parts = F.filter(F.transform(F.split(text, ","), lambda k: F.lower(trim_blanks(k))), lambda k: k != "")
    return F.when(F.coalesce(trim_blanks(text), F.lit("")) == "", automatic).otherwise(parts)


def suggested_keywords(text: Column, limit: int = 5) -> Column:
    """Keywords as they are suggested while a text is typed: none up to ten characters."""
    trimmed = trim_space(text)
    return keywords_of(F.when(F.length(trimmed) > 10, trimmed), limit)


def keyword_preview(keywords: Column, n: int = 3) -> Column:
    """The first few keywords."""
    return F.slice(keywords, 1, n)


def strip_html(html: Column) -> Column:
    """Text of HTML by plain replacements, in order and with regard to case; ``&amp;lt;`` becomes ``<`` as ampersands come first."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return trim_space(html)


# The replacements that turn HTML into text, in order.
HTML_STEPS = [
    ("<style[^>]*>[\\s\\S]*?</style>", " "),
    ("<script[^>]*>[\\s\\S]*?</script>", " "),
    ("<br[^>]*>", "\n"),
    ("<p[^>]*>", "\n\n"),
    ("<[^>]+>", " "),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("[\\t\\n\\f\\r\\p{Z}]*\\n[\\t\\n\\f\\r\\p{Z}]*\\n[\\t\\n\\f\\r\\p{Z}]*", "\n\n"),
    ("[ \\t]+", " "),
]


def auto_title(text: Column, length: int = 30) -> Column:
    """The beginning of a text as a title."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def tool_name(name: Column) -> Column:
    """A name as an identifier: blanks to underscores, lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(F.replace(name, F.lit(" "), F.lit("_"))), "[^\\p{L}\\p{M}\\p{N}_]", "")


def fact_lines(df: DataFrame, key: str, text: str, limit: int = 5) -> DataFrame:
    """(key, line, content, keywords) of answers with a fact on each line, ``[keyword, keyword] fact`` or free text.

    Blank lines and NONE are passed over; a bracketed line needs a fact and a keyword, free text at least one significant word.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__l")).withColumn("__l", trim_blanks(F.col("__l")))
    lines = lines.where((F.col("__l") != "") & (F.upper("__l") != "NONE"))
    form = "^\\[([^\\]]*)\\]([\\s\\S]*)$"
    marked = F.col("__l").rlike(form)
    listed = lines.where(marked).select(key, "line", trim_blanks(F.regexp_extract("__l", form, 2)).alias("content"), keyword_list(F.regexp_extract("__l", form, 1), F.array().cast("array<string>")).alias("keywords"))
    free = lines.where(~marked).select(key, "line", F.col("__l").alias("content"), keywords_of(F.col("__l"), limit).alias("keywords"))
    return listed.unionByName(free).where((F.col("content") != "") & (F.size("keywords") > 0))
