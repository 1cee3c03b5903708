"""The capped memory log: newest first, no two entries of one content, the oldest fall out.

An add is refused if its content is held at that time; an entry that fell out may come again. So the outcome depends on the order of
all adds. It is replayed in parallel: a log is cut into spans, each of which is simulated from an empty log. Then the spans are repaired in order:
from what is held before it a span is simulated again, beside the simulation from nothing, only until both hold the same; from there on the
first simulation was right. So little more than the heads of the spans goes through one task, and the result is that of the plain fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import SPACE, keyword_list, keywords_of, trim_space
from quarry.schemas import effective_domain
from quarry.storage import kept

def add_all(held: list[tuple[int, str]], adds: Iterator[tuple[int, str]], capacity: int) -> list[tuple[int, str]]:
    """Entries (seq, content), oldest first, after more adds in order."""
    kept = dict((c, s) for s, c in held)  # by content; insertion order is age
    for seq, content in adds:
        if content in kept:
            continue
        kept[content] = seq
        if len(kept) > capacity:
            del kept[next(iter(kept))]
    return [(s, c) for c, s in kept.items()]


SPANS = "log string, span long, ending boolean, at long, seq long, digest string, adds long"


def _put(held: dict[str, int], digest: str, seq: int, capacity: int) -> None:
    """One add to the held entries, by digest, the oldest first."""
    if digest not in held:
        held[digest] = seq
        if len(held) > capacity:
            del held[next(iter(held))]


def span_heads(adds: DataFrame, capacity: int, head: int, spans: int | None = None) -> DataFrame:
    """The first ``head`` adds of each span of (log, seq, digest), and what is held at its end if nothing was before it.

    A span is what a task has of a log, by ranges of (log, seq); ``adds`` counts its rows. A task holds ``capacity`` entries.
    """

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span, log, held, n, begun, out = TaskContext.get().partitionId(), None, {}, 0, False, []
        for pdf in batches:
            for name, seq, digest in zip(pdf["log"].tolist(), pdf["seq"].tolist(), pdf["digest"].tolist(), strict=True):
                if not begun or name != log:
                    out += [(log, span, True, i, s, d, n) for i, (d, s) in enumerate(held.items())]
                    log, held, n, begun = name, {}, 0, True
                if n < head:
                    out.append((log, span, False, n, seq, digest, 0))
                n += 1
                _put(held, digest, seq, capacity)
            if out:
                yield pd.DataFrame(out, columns=["log", "span", "ending", "at", "seq", "digest", "adds"])
                out = []
        out = [(log, span, True, i, s, d, n) for i, (d, s) in enumerate(held.items())]
        if out:
            yield pd.DataFrame(out, columns=["log", "span", "ending", "at", "seq", "digest", "adds"])

    dealt = adds.repartitionByRange(*([spans] if spans else []), "log", "seq", "digest").sortWithinPartitions("log", "seq", "digest")
    return dealt.mapInPandas(simulate, SPANS)


def repaired(heads: DataFrame, capacity: int) -> DataFrame:
    """(log, seq, digest) held after all spans; for a log in which a head is too short to tell, one row without a digest."""

    def after(held: dict[str, int], head: list[tuple[int, str]], end: dict[str, int], adds: int) -> dict[str, int] | None:
        true, fresh = dict(held), {}
        for seq, digest in head:
            if len(true) == len(fresh) and list(true.items()) == list(fresh.items()):
                return end
            _put(true, digest, seq, capacity)
            _put(fresh, digest, seq, capacity)
        if len(head) == adds:
            return true
        return end if list(true.items()) == list(fresh.items()) else None

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, span, begun, held, head, end, adds = None, None, False, {}, [], {}, 0

        def ended() -> pd.DataFrame:
            rows = [(log, -1, None)] if held is None else [(log, s, d) for d, s in held.items()]
            return pd.DataFrame(rows, columns=["log", "seq", "digest"])

        for pdf in batches:
            for name, part, ending, seq, digest, n in zip(*(pdf[c].tolist() for c in ("log", "span", "ending", "seq", "digest", "adds")), strict=True):
                if begun and (name != log or part != span):
                    held = after(held, head, end, adds) if held is not None else None
                    head, end = [], {}
                    if name != log:
                        yield ended()
                        held = {}
                log, span, begun = name, part, True
                if ending:
                    end[digest], adds = seq, n
                else:
                    head.append((seq, digest))
        if begun:
            held = after(held, head, end, adds) if held is not None else None
            yield ended()

    return heads.repartition("log").sortWithinPartitions("log", "span", "ending", "at").mapInPandas(fold, "log string, seq long, digest string")


def memory_log(adds: DataFrame, capacity: int = 100, head: int | None = None, spans: int | None = None) -> DataFrame:
    """(log, seq, content) held after all adds (log, seq, content), blank contents left out.

    Only places and digests of contents are replayed; the contents of what is held are fetched afterwards. Of adds with equal log and seq
    the smaller digest goes first; adds that repeat log, seq and content are one. Adds without a log are a log of their own. ``head`` adds of each
    span are seen again at first (by default ten times the capacity); logs for which that is too few are replayed with more, at last with all.
    """
    rows = adds.where(F.col("content").rlike(f"[^{SPACE[1:-2]}]")).select(F.col("log").cast("string").alias("log"), F.col("seq").cast("long").alias("seq"), "content")
    digest = F.sha2(F.col("content").cast("binary"), 256)
    left, head, done = kept(rows.select("log", "seq", digest.alias("digest")), "log-adds"), head or 10 * capacity, None
    while True:
        found = kept(repaired(span_heads(left, capacity, head, spans), capacity), "log-held")
        done = found.where("digest is not null") if done is None else done.union(found.where("digest is not null"))
        open_ = found.where("digest is null").select(F.col("log").alias("__log"))
        if not open_.limit(1).count():
            break
        left, head = left.join(open_, F.col("log").eqNullSafe(F.col("__log")), "left_semi"), head * 32
    held = done.select(F.col("log").alias("__log"), F.col("seq").alias("__seq"), F.col("digest").alias("__digest"))
    whole = rows.join(held, F.col("log").eqNullSafe(F.col("__log")) & (F.col("seq") == F.col("__seq"))).where(digest == F.col("__digest"))
    return whole.select("log", "seq", "content").dropDuplicates(["log", "seq", "content"])


def saved(memories: DataFrame, entry: DataFrame, capacity: int = 100) -> DataFrame:
    """``memories`` (id, content, keywords, source_title, created_at, domain_id, embedding) with new entries (the same, ``typed`` for keywords), as they are saved by hand.

    Typed keywords are parsed at commas, or else found in the text; a blank text or one that is held is refused; the newest ``capacity`` stay.
    """
    text = trim_space(F.col("content"))
    rows = entry.withColumn("content", text).where(F.col("content") != "")
    rows = rows.withColumn("keywords", keyword_list(F.col("typed"), keywords_of(F.col("content"), 5))).drop("typed")
    fresh = rows.join(memories.select("content"), "content", "left_anti")
    first = F.row_number().over(W.partitionBy("content").orderBy("created_at", "id"))
    fresh = fresh.withColumn("__r", first).where("__r = 1").drop("__r")
    return memories.unionByName(fresh.select(*memories.columns)).orderBy(F.desc("created_at"), F.desc("id")).limit(capacity)


def deleted(memories: DataFrame, id_: str | int | None = None, key: str = "id") -> DataFrame:
    """Without one entry, or without all."""
    return memories.where(F.col(key) != id_) if id_ is not None else memories.limit(0)


def of_domain(memories: DataFrame, domain: str) -> DataFrame:
    """The entries of a domain; those without one are the default one's."""
    return memories.where(effective_domain(F.col("domain_id")) == domain)


def moved(memories: DataFrame, id_: str | int, domain: str, key: str = "id") -> DataFrame:
    """An entry in another domain; an unknown id changes nothing."""
    return memories.withColumn("domain_id", F.when(F.col(key) == id_, F.lit(domain)).otherwise(F.col("domain_id")))


def updated(memories: DataFrame, id_: str, content: str, keywords: list[str]) -> DataFrame:
    """One entry's new content and keywords; its vector is cleared, to be made again, if the content is another."""
    hit = F.col("id") == id_
    words = F.array(*(F.lit(k.lower()) for k in keywords)) if keywords else F.array().cast("array<string>")
    out = memories.withColumn("embedding", F.when(hit & (F.col("content") != content), F.lit(None)).otherwise(F.col("embedding")))
    return out.withColumn("keywords", F.when(hit, words).otherwise(F.col("keywords"))).withColumn("content", F.when(hit, F.lit(content)).otherwise(F.col("content")))


def filled(memories: DataFrame, embed) -> DataFrame:
    """Missing vectors made by the caller's function of a content column."""
    return memories.withColumn("embedding", F.coalesce("embedding", embed(F.col("content"))))
