"""Search for any part of a text, whatever the case, by an index of trigrams.

Every place of a text, in lower case, begins a trigram; the last two are filled up with a character that no text has. The trigrams are kept as a
``KeywordIndex``, so an index changes by generations. A question of three characters or more takes its rarest trigrams: rows must have
all of them, and what they leave is checked on the text. A shorter question is the beginning of trigrams, which answer it without a look at texts.

A question of up to ``LONGEST`` characters without white space lies within a token of a text, so it needs no trigrams: the parts of a block's tokens are
looked up among such questions. That takes time for each token, not for each pair of a question and a block.

Questions and the index's rows meet in pairs of blocks (``blocks``), so what trigrams leave stays in its task and only what is found comes out.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.operators.keyword_index import KeywordIndex

FILL = "￿"  # not a character
SPACES = "[\\x20\\x09-\\x0D]"
LONGEST = 32
QUESTIONS = 1 << 16


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for an empty or null one."""
    low = F.lower(text)
    fill = F.lit(FILL)

    def made(chars: Column) -> Column:
        return F.array_distinct(F.transform(chars, lambda c, i: F.concat(c, F.coalesce(F.get(chars, i + 1), fill), F.coalesce(F.get(chars, i + 2), fill))))

    chars = F.when(F.length(low) > 0, F.split(low, "")).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(chars), made), F.lit(0))  # a text is cut into its characters once


def put_texts(index: KeywordIndex, rows: DataFrame, content: str, deleted: DataFrame | None = None, change: str | None = None) -> KeywordIndex:
    """Texts (the index's keys, content) put into an index of trigrams, in place of those with their keys; see ``KeywordIndex.changed``."""
    return index.changed(put=rows, deleted=deleted, change=change, words=trigrams(F.col(content)))


def containing(index: KeywordIndex, rows: DataFrame, queries: DataFrame, content: str, rarest: int = 3) -> DataFrame:
    """(query_id, keys): for each question (query_id, text) the rows (keys, content) that the index has and whose content holds its text.

    An empty question finds every row, as no filter is set; a null one none. ``rows`` are those that were put in; their texts are only looked at for
    rows that have the ``rarest`` trigrams of a question.
    """
    id_ = F.struct(*index.keys).alias("id")
    asked = queries.where("text is not null").groupBy(F.col("query_id").alias("id")).agg(F.collect_set(F.lower("text")).alias("words"))
    some = asked.where("not array_contains(words, '')")
    in_token = F.forall("words", lambda q: ~q.rlike(SPACES) & (F.length(q) <= LONGEST))
    parts = []
    inner, others = some.where(in_token), some.where(~in_token)
    if not inner.isEmpty():
        tokens = rows.select(id_, F.array_distinct(F.split(F.lower(content), SPACES + "+")).alias("words"))
        tokens = tokens.join(index.words().select("id"), "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))

        def within(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
            for q, d in token_matches(blocks.read(block), blocks.read(block, "q_"), len(block.column("id").flatten())):
                yield q, d, []

        parts.append(blocks.met(blocks.packed(tokens, "substring-tokens"), blocks.question_blocks(inner, "substring-words", QUESTIONS), within))
    if not others.isEmpty():
        words = index.words().groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
        texts = rows.groupBy(id_).agg(F.collect_set(F.lower(content)).alias("texts"))

        def found(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
            q, d = block_matches(blocks.read(block), blocks.read(block, "q_"), block.column("texts").flatten().to_pylist(), rarest)
            yield q, d, []

        parts.append(blocks.met(blocks.packed(words.join(texts, "id"), "substring-rows"), blocks.question_blocks(others, "substring-questions"), found))
    out = asked.where("array_contains(words, '')").select(F.col("id").alias("query_id")).crossJoin(rows.select(id_).distinct())
    for part in parts:
        out = part.union(out)
    return out.select("query_id", "id.*")


def token_matches(tokens: blocks.Words, asked: blocks.Words, rows: int, entries: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, row) of a pair of blocks, some ``entries`` at a time; each of a row's ``tokens`` is cut into all parts that are as long as a question."""
    known = {q: i for i, q in enumerate(asked.vocabulary.to_pylist())}
    lengths = sorted({len(q) for q in known})
    text, token = array("i"), array("i")
    for t, word in enumerate(tokens.vocabulary.to_pylist()):
        size = len(word)
        found = {known.get(word[a : a + n]) for n in lengths if n <= size for a in range(size - n + 1)}
        found.discard(None)
        text.extend(found)
        token.extend([t] * len(found))
    if not text:
        return
    text, token = np.frombuffer(text, "i4"), np.frombuffer(token, "i4")
    a, b = asked.starts[text], asked.starts[text + 1]
    q, token = asked.rows[blocks.slices(a, b)], np.repeat(token, b - a)
    order = np.argsort(q, kind="stable")
    q, a, b = q[order].astype(np.int64), tokens.starts[token[order]], tokens.starts[token[order] + 1]
    part = np.cumsum(b - a) // entries
    edges = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    edges = edges[np.concatenate(([True], part[edges[1:]] != part[edges[:-1]]))]  # what is found for a question stays together
    for s, e in zip(edges, [*edges[1:], len(q)], strict=True):
        yield np.divmod(np.unique(np.repeat(q[s:e], b[s:e] - a[s:e]) * rows + tokens.rows[blocks.slices(a[s:e], b[s:e])]), rows)


def block_matches(trigrams: blocks.Words, asked: blocks.Words, texts: list[list[str]], rarest: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of a pair of blocks. The words of ``asked`` are what is looked for, in lower case."""
    known, starts = trigrams.vocabulary.to_pylist(), trigrams.starts.tolist()
    place, mark, rows = {g: i for i, g in enumerate(known)}, np.zeros(len(texts), bool), trigrams.rows
    single = [t[0] if len(t) == 1 else None for t in texts]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for q, (a, b) in zip(asked.vocabulary.to_pylist(), zip(asked.starts, asked.ends, strict=False), strict=True):
        if len(q) < 3:
            d = np.unique(rows[starts[bisect_left(known, q)] : starts[bisect_left(known, q + "\U0010ffff" * 3)]])
        else:
            at = [place.get(g) for g in {q[i : i + 3] for i in range(len(q) - 2)}]
            if None in at:
                continue
            first, *more = sorted((starts[i + 1] - starts[i], i) for i in at)[:rarest]
            d = rows[starts[first[1]] : starts[first[1] + 1]]
            for _, i in more:
                mine = rows[starts[i] : starts[i + 1]]
                mark[mine] = True
                d = d[mark[d]]
                mark[mine] = False
            d = np.array([i for i in d.tolist() if (q in single[i] if single[i] is not None else any(q in t for t in texts[i]))], np.int64)
        if len(d):
            by = asked.rows[a:b]
            out.append((np.repeat(by, len(d)), np.tile(d, len(by))))
    q, d = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(asked.rows) > len(np.unique(asked.rows)):  # a question of several texts
        q, d = np.divmod(np.unique(q * len(texts) + d), len(texts))
    return q, d
