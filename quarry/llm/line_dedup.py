"""Line dedup across documents by a deletion-neighbourhood join (DataFrame functions only).

The edit unit is the word: two lines of ``fuzzy_words`` words or more are near copies if one edit (a word put in, left out or replaced)
turns one into the other; shorter lines must be equal. Words are compared in lower case, so spacing and case don't count. A line goes
if an equal or near copy stands earlier, by (doc_id, line number); lines under ``min_words`` words, blank ones among them, always stay.

Every line with one word left out is a variant, filed under its hash; near copies meet under an equal variant. Lines that meet with
the word left out at the same place are all one edit apart, and of lines that meet an unshortened line, that line is the witness: so
each variant needs only the earliest line of each kind, a minimum that is aggregated before the shuffle, and no pairs are listed.
As one edit leaves the left or the right half of a line as it is, variants are made only for lines that share a half with another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, numbered, running, scope, small


@dataclass(frozen=True)
class LineDedup:
    min_words: int = 3
    fuzzy_words: int = 8


#: White space that parts words, as an alternative to the others.
GAPS = "\t\n\x0b\f\r"


def _words(line: Column) -> Column:
    """The words of a line in lower case. White space is made blanks first, as a split at one character needs no pattern."""
    return F.filter(F.split(F.translate(F.lower(line), GAPS, " " * len(GAPS)), " "), lambda w: w != "")


def _lines(docs: DataFrame, min_words: int = 0) -> DataFrame:
    """doc_id, pos, words of every line with so many words."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.where(_has_words(F.col("line"), min_words)) if min_words else lines
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), _words(F.col("line")).alias("words"))


def _has_words(line: Column, n: int) -> Column:
    """So many words at least; the pattern ends where it knows."""
    return line.rlike("^[\\x20\\x09-\\x0D]*" + "[\\x20\\x09-\\x0D]+".join(["[^\\x20\\x09-\\x0D]+"] * (n - 1) + ["[^\\x20\\x09-\\x0D]"]))


def _at(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df`` (doc_id, pos, ...) with the words of its lines; only documents that it names are split. ``df`` is cut."""
    there = small(df)
    few = docs.join(small(cut(df.select("doc_id").distinct(), "line-docs")), "doc_id", "left_semi")
    return _lines(few).join(there, ["doc_id", "pos"])


def _halves(words: Column, n: Column) -> list[Column]:
    """Hashes of (side, length of the shorter line, half), from the words' hashes, for each way in which a near copy can share a half."""
    m = n - 1
    half, lesser = F.shiftright(n, 1), F.shiftright(m, 1)
    rest = m - lesser
    ways = [
        (0, n, F.slice(words, F.lit(1), half)),
        (1, n, F.slice(words, half + 1, n)),
        (0, m, F.slice(words, F.lit(1), lesser)),
        (1, m, F.slice(words, n - rest + 1, F.greatest(rest, F.lit(1)))),
    ]
    return [F.xxhash64(part, F.lit(side), k).alias(f"half{i}") for i, (side, k, part) in enumerate(ways)]


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def _keys_without_one(here: Column, before: Column) -> Column:
    """For each word, the key of its line without that word: the xor of the hashes of the other words with their places.

    ``here`` has the hashes of the words with their own places, ``before`` those with the places one less, which words behind a missing
    one take. From one key to the next only two hashes change, so the keys are a running xor, worked out by doubling steps.
    """
    n = F.size(here)
    first = _xor(F.slice(before, F.lit(2), F.greatest(n, F.lit(1))))  # without the first word
    change = F.zip_with(F.slice(here, F.lit(1), n - 1), F.slice(before, F.lit(2), F.greatest(n, F.lit(1))), lambda x, y: x.bitwiseXOR(y))
    return running(F.concat(F.array(first), change), lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long"))


def _near(a: Column, b: Column) -> Column:
    """One word edit at most lies between the word lists."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, F.lit(True)).cast("int")
    size_a, size_b = F.size(a), F.size(b)
    tail = lambda x, k: F.slice(x, k, F.greatest(F.size(x), F.lit(1)))
    return (
        (at == 0)
        | ((size_a == size_b) & (tail(a, at + 1) == tail(b, at + 1)))
        | ((size_a == size_b + 1) & (tail(a, at + 1) == tail(b, at)))
        | ((size_a + 1 == size_b) & (tail(a, at) == tail(b, at + 1)))
    )


def near_copies(lines: DataFrame, docs: DataFrame, p: LineDedup) -> DataFrame:
    """(doc_id, pos, witness): the distinct lines of a cut table that are a near copy of an earlier one."""
    halves = lines.where(F.col("n") >= p.fuzzy_words).select("doc_id", "pos", F.posexplode(F.array("half0", "half1", "half2", "half3")).alias("way", "half"))
    many = cut(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "halves")
    sides = cut(halves.join(small(many), "half", "left_semi").groupBy("doc_id", "pos").agg(F.max(F.col("way") % 2 == 0).alias("left"), F.max(F.col("way") % 2 == 1).alias("right")), "sides")

    texts = cut(_at(sides, docs), "candidates")  # the only time that texts are read for near copies
    keyed = texts.select("doc_id", "pos", "left", "right", F.transform("words", lambda w, i: F.xxhash64(w, i + 1)).alias("here"), F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("before"))
    n = F.size("here")
    needed = lambda i: (F.col("left") & (i >= n / 2)) | (F.col("right") & (i <= n / 2 + 1))
    without = F.filter(F.transform(_keys_without_one(F.col("here"), F.col("before")), lambda k, i: F.struct((i + 1).alias("i"), k.alias("key"))), lambda v: needed(v["i"]))
    whole = F.array(F.struct(F.lit(0).alias("i"), _xor(F.col("here")).alias("key")))  # nothing left out
    variants = cut(keyed.select("doc_id", "pos", F.explode(F.concat(without, whole)).alias("v")).select("doc_id", "pos", "v.i", "v.key"), "variants")

    line = F.struct("doc_id", "pos")
    same = variants.where("i > 0").groupBy("key", "i").agg(F.min(line).alias("witness"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    short, full = F.min(F.when(F.col("i") > 0, line)), F.min(F.when(F.col("i") == 0, line))
    other = variants.groupBy("key").agg(short.alias("short"), full.alias("full")).where("short is not null and full is not null")
    # a line that is met in full is compared with the earliest shortened one, a shortened one with the full one
    met = cut(same.select("key", "i", "witness").union(other.select("key", F.lit(0), "short")).union(other.select("key", F.lit(-1), "full")), "met")
    there = small(met)
    replaced = variants.join(there, ["key", "i"]).select("doc_id", "pos", "witness")
    added = variants.where("i > 0").join(there.where("i = -1").drop("i"), "key").select("doc_id", "pos", "witness")
    found = replaced.union(added).where(F.col("witness") < line).groupBy("doc_id", "pos").agg(F.min("witness").alias("witness"))
    named = cut(found, "near-lines")

    # verify the edit distance on the words themselves; other witnesses share the variant, so a failed check means equal hashes only
    ours = texts.select("doc_id", "pos", F.col("words").alias("a")).join(small(named), ["doc_id", "pos"])
    theirs = texts.select(F.struct("doc_id", "pos").alias("witness"), F.col("words").alias("b"))
    return ours.join(theirs, "witness").where(_near(F.col("a"), F.col("b"))).select("doc_id", "pos", "witness")


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the repeated lines taken out of ``text``, and n_lines, n_dropped (long).

    Null and empty texts stay as they are, with one (blank) line. All copies of a line but the earliest go, within a document too; an
    earlier near copy counts even if it goes itself. Rows that repeat a doc_id and rows without one (they come last) are documents of
    their own, in the order of a hash of the text. Columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
    A line may have very many words: its variants cost their number times its logarithm.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [c for c in columns if c not in ("doc_id", "text")]
    nested = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else []  # so no name of the caller's clashes with ours
    docs, new = numbered(docs.select("doc_id", "text", *nested))
    source = docs.select("doc_id", "text")
    w = F.col("w")
    lines = _lines(source, p.min_words).select("doc_id", "pos", F.transform("words", lambda x: F.xxhash64(x)).alias("w"))
    lines = lines.select("doc_id", "pos", F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.hash("w").alias("g"), *_halves(w, F.size("w")))
    first = lines.groupBy("n", "h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), *(F.any_value(f"half{i}").alias(f"half{i}") for i in range(4)))
    with scope(docs.sparkSession):
        distinct = cut(first.select("n", "first.*", "half0", "half1", "half2", "half3"), "lines")
        near = cut(near_copies(distinct, source, p).select("doc_id", "pos").distinct(), "dropped")
        stay = cut(distinct.select("doc_id", "pos").join(small(near), ["doc_id", "pos"], "left_anti"), "stay", keep=True)
    kept = stay.groupBy("doc_id").agg(F.collect_list("pos").alias("__keep"))

    all_lines = F.split("text", "\n")
    brief = F.filter(F.transform(all_lines, lambda x, i: F.when(~_has_words(x, p.min_words), i.cast("long"))), lambda i: i.isNotNull())
    stay = F.array_sort(F.array_union(brief, F.coalesce("__keep", F.array().cast("array<long>"))))
    out = docs.join(kept, "doc_id", "left").withColumn("__lines", all_lines).withColumn("__stay", stay)
    text = F.array_join(F.transform("__stay", lambda i: F.get("__lines", i.cast("int"))), "\n")
    n = F.coalesce(F.size("__lines"), F.lit(1)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(1).cast("long")).otherwise(n)
    gone = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("__stay"))
    out = out.withColumns({"text": F.when(F.col("text").isNotNull(), text), "n_lines": n, "n_dropped": gone})
    out = out.withColumn("doc_id", F.col("named")) if new else out
    return out.select(*(c if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in columns), "n_lines", "n_dropped")
