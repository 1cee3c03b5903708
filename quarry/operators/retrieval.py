"""Retrieval: by vector, by keyword, and keyword-then-vector; ties go to the smaller key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.functions.vectors import cosine, dot, literal, recency_bonus

PREFIX = 5


def vector_topk(rows: DataFrame, query: list[float], key: str, k: int = 3, threshold: float = 0.3, vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most similar to the query (unit vectors), strictly above the threshold, with ``score``."""
    scored = rows.where(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("score", dot(F.col(vector), literal(query)))
    return scored.where(F.col("score") > threshold).orderBy(F.desc("score"), key).limit(k)


def inverted_index(chunks: DataFrame, key: str, content: str = "content", keywords: str | None = None) -> DataFrame:
    """(word, key): distinct words of content and keywords."""
    words = tokenize(F.col(content))
    words = F.array_union(words, F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), F.lower)) if keywords else words
    return chunks.select(F.explode(words).alias("word"), key)


def candidates_exact(index: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Distinct keys of index rows with one of the words."""
    return index.join(words.select("word"), "word", "left_semi").select(key).distinct()


def prefix_matches(index: DataFrame, words: DataFrame) -> DataFrame:
    """Index rows and query words (``query_word``) of which one begins with the other, both of five characters or more.

    Both share their first five characters then, which makes it an equi-join.
    """
    long = words.where(F.length("word") >= PREFIX).select(F.col("word").alias("query_word"), F.substring("word", 1, PREFIX).alias("__p"))
    entries = index.where(F.length("word") >= PREFIX).withColumn("__p", F.substring("word", 1, PREFIX))
    return entries.join(long, "__p").where(F.col("word").startswith(F.col("query_word")) | F.col("query_word").startswith(F.col("word"))).drop("__p")


def candidates(index: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Keys with an equal or a prefix match."""
    return candidates_exact(index, words, key).union(prefix_matches(index, words).select(key)).distinct()


def query_words(spark, text: str) -> list[str]:
    """The distinct significant words of a query: a few strings."""
    return list(spark.range(1).select(tokenize(F.lit(text)).alias("w")).first()["w"])


def _near_words(words: str | Column, query: list[str]) -> Column:
    """The words of a row that can match one of the query's words: equal, or alike in the first five characters."""
    starts = sorted({w[:PREFIX] for w in query if len(w) >= PREFIX})
    return F.filter(words, lambda e: e.isin(query) | F.substring(e, 1, PREFIX).isin(starts) if starts else e.isin(query))


def narrowed(rows: DataFrame, query: list[str], words: str = "words") -> DataFrame:
    """``rows`` with only those of their words that can match the query's: for before a join, which then moves next to nothing."""
    return rows.withColumn(words, _near_words(words, query))


def _match(e: Column, w: str) -> Column:
    """What a row's word gives for a word of the query: 1 if equal, 0.5 if one begins with the other and both have five characters, else 0."""
    found = F.when(e == w, 1.0)
    return (found.when((F.length(e) >= PREFIX) & (e.startswith(w) | F.lit(w).startswith(e)), 0.5) if len(w) >= PREFIX else found).otherwise(0.0)


def keyword_scored(rows: DataFrame, query: list[str], name: str, words: str = "words") -> DataFrame:
    """``rows`` with a score in place of their words: over the query's words the best match, divided by their number.

    The words that may match are taken out of a row once; all is worked out within the row, so rows that share a key, or have none, stay rows
    of their own, and nothing is shuffled.
    """

    def match(near: Column, w: str) -> Column:
        return F.aggregate(near, F.lit(0.0), lambda s, e: F.greatest(s, _match(e, w)))

    def best(near: Column) -> Column:
        return sum((match(near, w) for w in query), F.lit(0.0)) / max(1, len(query))

    score = F.transform(F.array(_near_words(words, query)), best)  # of one entry; as a generator's output a filter on it isn't worked out twice
    return rows.select(*[c for c in rows.columns if c not in (words, name)], F.explode(score).alias(name))


def keyword_retrieve(rows: DataFrame, query: list[str], key: str, k: int = 3, least: float = 0.30, words: str = "words") -> DataFrame:
    """The ``k`` rows that match the query's words best, with ``score``; none for a query without words."""
    if not query:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    return keyword_scored(rows, query, "score", words).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def best_of(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query by ``score``, ties to the smaller key."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def two_phase(rows: DataFrame, query: list[float], words: list[str], key: str, k: int = 3, many: int = 200, own: Column | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Vector top-k over the rows that a keyword match reaches.

    ``hits`` (key) are the rows that a kept index finds for the question; without them the rows' own ``words`` are looked at.
    ``rows`` (key, words, embedding) are those of all domains, ``own`` holds for those of the domain asked (by default all). All of its rows
    with a vector are scored if there are under ``many``, if under max(3 k, 20) candidates are found among all rows, with or without a
    vector, or none with one in this domain. The counts are one row of the same plan; products are only made for rows that are scored.
    """
    own = F.lit(True) if own is None else own
    if hits is not None:
        rows, hit = rows.join(hits.select(key, F.lit(True).alias("__found")), key, "left"), F.col("__found")
    else:
        hit = F.size(_hits("words", words)) > 0 if words else F.lit(False)
    usable = F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)), F.lit(False))
    flagged = rows.select(*[c for c in rows.columns if c not in ("words", "__found")], (F.coalesce(own, F.lit(False)) & usable).alias("__own"), F.coalesce(hit, F.lit(False)).alias("__hit"))
    counts = flagged.agg(F.count_if("__own").alias("__rows"), F.count_if("__hit").alias("__all"), F.count_if(F.col("__own") & F.col("__hit")).alias("__both"))
    every = (F.col("__rows") < many) | (F.col("__all") < max(3 * k, 20)) | (F.col("__both") == 0)
    chosen = flagged.where("__own").crossJoin(F.broadcast(counts)).where(F.col("__hit") | every)
    return vector_topk(chosen.drop("__own", "__hit", "__rows", "__all", "__both"), query, key, k)


def _hits(words: str, query: list[str]) -> Column:
    """A row's words that match the query, equal or by prefix."""
    long = [w for w in query if len(w) >= PREFIX]
    near = lambda e: sum((F.when(e.startswith(w) | F.lit(w).startswith(e), 1).otherwise(0) for w in long), F.lit(0)) > 0
    return F.filter(_near_words(words, query), lambda e: e.isin(query) | ((F.length(e) >= PREFIX) & near(e)))


def retrieve(rows: DataFrame, query: list[float] | None, words: list[str], key: str, k: int = 3, domain: str | Column | None = None) -> DataFrame:
    """The rows (key, words, embedding, domain_id) of a domain that answer a question, with ``score``.

    If the question has a vector, by keyword and then vector, even if that gives nothing; else by keywords.
    """
    own = F.lit(True) if domain is None else F.col("domain_id") == domain
    return two_phase(rows, query, words, key, k, own=own) if query is not None else keyword_retrieve(rows.where(own), words, key, k)


def memory_retrieve(rows: DataFrame, query: list[float] | None, words: list[str], now: Column, key: str, k: int = 5) -> DataFrame:
    """The memories that fit a query: by similarity above 0.3 with a small bonus for new ones, or else by keywords (0.25 or more).

    ``rows``: key, words, created_at, embedding. Adds ``score`` (the rank is by it). Whether any memory is similar is a row of the same plan, so
    nothing runs before the result is asked for; once it is known that one is, Spark leaves the keyword branch out.
    """
    bonus = recency_bonus(F.col("created_at"), now)
    best = lambda found: found.orderBy(F.desc("score"), key).limit(k)
    by_words = keyword_scored(rows, words, "__s").where(F.col("__s") >= 0.25) if words else rows.drop("words").withColumn("__s", F.lit(0.0)).limit(0)
    by_words = by_words.withColumn("score", F.col("__s") + bonus * 0.05).drop("__s")
    if query is None:
        return best(by_words)
    like = cosine(F.col("embedding"), literal(query))
    near = rows.drop("words").withColumn("__s", like).where(F.col("__s") > 0.3).withColumn("score", F.col("__s") + bonus * 0.02).drop("__s")
    none = rows.agg(F.coalesce(F.bool_or(like > 0.3), F.lit(False)).alias("__some")).where("not __some")
    return best(near.unionByName(by_words.crossJoin(F.broadcast(none)).drop("__some")))
