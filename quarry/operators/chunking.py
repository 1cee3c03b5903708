"""Chunking of section texts, as a fold over paragraphs that Catalyst evaluates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import keywords_of, trim_blanks, trim_space


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks_of(text: Column, target: int = 600, overlap: int = 100, least: int = 150) -> Column:
    """The chunks of one section.

    Paragraphs (split at blank lines, never cut) are gathered until the next would pass ``target``; a chunk of ``least`` or more is
    then given out, and the next begins with its last ``overlap`` characters. A rest under ``least`` joins the last chunk, or is
    dropped if there is none.

    The fold carries whole numbers only: which paragraphs a chunk has, and how many characters of what stands before them. A chunk is a piece of
    all paragraphs put together, so its text is made once, at the end, from its paragraphs and the few before them.
    """
    reach = overlap // 3 + 2  # as many paragraphs, with what parts them, have ``overlap`` characters at least
    none = F.array().cast("array<struct<first:int,last:int,tail:int>>")
    places = ("n", "first", "tail", "i")
    start = F.struct(*(F.lit(0).alias(c) for c in places), F.array().cast("array<array<struct<first:int,last:int,tail:int>>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["n"] + p + 2 > target) & (s["n"] >= least)
        tail = F.least(s["n"], F.lit(overlap))
        done = F.struct(s["first"].alias("first"), s["i"].alias("last"), s["tail"].alias("tail"))
        return F.struct(
            F.when(full, tail + 2 + p).when(s["n"] > 0, s["n"] + 2 + p).otherwise(p).alias("n"),
            F.when(full, s["i"]).otherwise(s["first"]).alias("first"),
            F.when(full, tail).otherwise(s["tail"]).alias("tail"),
            (s["i"] + 1).alias("i"),
            F.when(full, F.concat(s["out"], F.array(done))).otherwise(s["out"]).alias("out"),
        )

    def steps(s: Column, lengths: Column) -> Column:
        """A group of paragraphs; so the list of chunks that grows step by step stays short."""
        begun = F.struct(*(s[c].alias(c) for c in places), none.alias("out"))
        return once(F.aggregate(lengths, begun, step), lambda r: F.struct(*(r[c].alias(c) for c in places), F.concat(s["out"], F.array(r["out"])).alias("out")))

    def grouped(lengths: Column) -> Column:
        size = 256
        last = F.floor((F.size(lengths) - 1) / size).cast("int")
        numbers = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.slice(lengths, i * size + 1, F.lit(size)))

    def made(paragraphs: Column) -> Column:
        def joined(first: Column, end: Column) -> Column:  # a slice would go over the whole array
            return F.array_join(F.transform(F.sequence(first, end - 1), lambda i: F.get(paragraphs, i)), "\n\n")

        def content(c: Column) -> Column:
            mine = joined(c["first"], c["last"])
            before = F.right(joined(F.greatest(c["first"] - reach, F.lit(0)), c["first"]), c["tail"])
            return trim_space(F.when(c["tail"] > 0, F.concat(before, F.lit("\n\n"), mine)).otherwise(mine))

        def end(s: Column) -> Column:
            rest = F.struct(s["first"].alias("first"), s["i"].alias("last"), s["tail"].alias("tail"))
            texts = F.transform(F.concat(F.flatten(s["out"]), F.when(s["i"] > 0, F.array(rest)).otherwise(none)), content)
            return once(texts, closed)

        def closed(texts: Column) -> Column:
            n = F.size(texts)
            rest = F.get(texts, n - 1)
            whole = F.slice(texts, F.lit(1), F.greatest(n - 1, F.lit(0)))
            merged = F.concat(F.slice(texts, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(texts, n - 2), F.lit("\n\n"), rest)))
            return F.when((n == 0) | (F.length(rest) >= least), texts).when((rest != "") & (n > 1), merged).otherwise(whole)

        lengths = F.transform(paragraphs, lambda p: F.length(p))
        return once(F.aggregate(once(lengths, grouped), start, steps), end)

    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), trim_blanks), lambda p: p != "")
    return once(paragraphs, made)


def chunk_sections(sections: DataFrame, key: str = "kb_id") -> DataFrame:
    """(key, index, location_label, content) from sections (key, pos, label, text); the index runs on over a document's sections."""
    each = sections.select(key, "pos", "label", F.posexplode(chunks_of(F.col("text"))).alias("__i", "content"))
    index = F.row_number().over(W.partitionBy(key).orderBy("pos", "__i")) - 1
    return each.select(key, index.cast("long").alias("index"), F.col("label").alias("location_label"), "content")


def with_keywords(chunks: DataFrame, limit: int = 8) -> DataFrame:
    """Chunks with their most frequent words."""
    return chunks.withColumn("keywords", keywords_of(F.col("content"), limit))


def enumerated(rows: DataFrame, keys: list[str], order: str, span: int = 100_000, then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``index``: their place by ``order`` (a whole number), then by the columns ``then``, among those of equal keys, from 0.

    A key's rows are numbered in ranges of ``span`` values of the order, and the ranges' counts are summed, so no key is one task.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / span))
    counts = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__range")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(order, *then)) - 1
    out = ranged.withColumn("__i", inside).alias("a").join(before.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__range")])
    return out.select("a.*", (F.col("b.__before") + F.col("a.__i")).cast("long").alias("index")).drop("__range", "__i")
