"""MinHash near-dedup by a multi-index Hamming join.

Each text's set of word shingles becomes a signature of ``chunks * width`` minhash symbols of b bits. Two signatures that differ in at
most ``errors * chunks + chunks - 1`` symbols agree, by the pigeonhole principle, in some chunk up to ``errors`` symbols. So each
signature is filed once for every chunk and every choice of ``errors`` symbols of it to leave out: all pairs under the signature
distance meet in a bucket. Links are confirmed on the full shingle sets.

Equal sets are one class from the start. The pairs of a small bucket are listed. Buckets of more than ``listed`` members, which large
groups of near copies and common passages make, are joined to clusters where they share members. First each member of a cluster is
compared with one leader, the least member of its large buckets, in one linear pass, which connects what a group of near copies holds.
What is left is compared in blocks of bounded size: each pair of blocks in one task, by signature and then on the full sets, but never two
blocks of one group that the pass connected. So all pairs under the signature distance are compared or already connected, the pairs of
a group are never listed, and a group of near copies costs a pass and not a square.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, arrow_batches, cut, mix, numbered, scope, signed, small, span_hashes, text_pieces, word_spans


@dataclass(frozen=True)
class NearDedup:
    """Parameters. A text under ``words`` words is one shingle; similarity is ``similar`` hundredths at least.

    With the defaults, texts at similarity 0.85 differ in 10.5 of 70 symbols on average and in more than ``most`` = 27 with a
    probability below 1e-6; those at 0.8 (``similar=80``) stay below it with a probability of 0.9999.
    """

    words: int = 5
    similar: int = 85
    chunks: int = 14
    width: int = 5
    errors: int = 1
    listed: int = 16  # members of a bucket whose pairs are listed; larger ones are compared in blocks
    block_rows: int = 1024
    block_bytes: int = 8_000_000

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def most(self) -> int:
        """The signature distance under which all pairs are found."""
        return self.errors * self.chunks + self.chunks - 1


def shingle_sets(column, words: int):
    """For each text of an Arrow column its row and its sorted distinct 64-bit shingle hashes."""
    salt = mix(np.arange(1, words + 1, dtype=np.uint64))
    for i, j, data, offsets in text_pieces(column):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        count = len(hashes)
        rolled = np.zeros(max(0, count - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : count - words + 1 + k] if len(rolled) else rolled
        rolled = mix(rolled + salt[words - 1])
        for row in range(i, j):
            a, b = int(first[row - i]), int(first[row - i + 1])
            if b - a >= words:
                yield row, np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.uint64(0)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
                yield row, mix(np.array([whole], np.uint64) + salt[b - a - 1])
            else:
                yield row, np.zeros(0, np.uint64)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n, None], x[n:, None] | np.uint64(1)


def signature(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of each minhash of a set."""
    least = np.full(len(seeds[0]), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        np.minimum(least, ((hashes[None, at : at + (1 << 14)] ^ seeds[0]) * seeds[1]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """Of each text: set size, a 128-bit digest of the set, and the signature (null for an empty set)."""

    def of(batch: pa.RecordBatch):
        seeds = _seeds(p.symbols)
        n, h1, h2, sigs = [], [], [], []
        for _, hashes in shingle_sets(batch.column("text"), p.words):
            n.append(len(hashes))
            h1.append(np.add.reduce(hashes, dtype=np.uint64))
            h2.append(np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64))
            sigs.append(signature(hashes, seeds).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(np.array(h1, np.uint64))), pa.array(signed(np.array(h2, np.uint64))), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "h1", "h2", "sig"],
        )

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(of), SIGNED)


def bucket_keys(reps: DataFrame, p: NearDedup) -> DataFrame:
    """(key, rep): a row for each chunk and each choice of ``errors`` symbols of it that are left out."""
    kept = list(combinations(range(p.width), p.width - p.errors))

    def of(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, p.chunks, p.width).astype(np.uint64)
            out = np.empty((len(sig), p.chunks, len(kept)), np.uint64)
            for k, columns in enumerate(kept):
                key = np.zeros(sig.shape[:2], np.uint64)
                for c in columns:
                    key = mix(key * np.uint64(0x10001) + sig[:, :, c] + np.uint64(1))
                out[:, :, k] = mix(key + np.arange(p.chunks, dtype=np.uint64)[None, :] * np.uint64(len(kept)) + np.uint64(k))
            rep = np.repeat(np.asarray(part.column("rep")), p.chunks * len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(signed(out.reshape(-1))), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(arrow_batches(of), "key long, rep long")


def near_signatures(pairs: DataFrame, reps: DataFrame, p: NearDedup) -> DataFrame:
    """Those pairs (a, b) whose signatures differ in at most ``p.most`` symbols."""

    def of(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        near = pa.array((x != y).sum(axis=1) <= p.most)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    sigs = reps.select("rep", "sig")
    both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(arrow_batches(of), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, p: NearDedup) -> DataFrame:
    """Those pairs whose full shingle sets are similar enough. ``pairs`` is a cut table."""

    def similar(batch: pa.RecordBatch):
        sides = ((np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)) for c in ("words_a", "words_b"))
        keep = pa.array([_similar(x, y, p) for x, y in zip(*sides, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    found = word_sets(docs, ids, p)
    both = pairs.join(found.toDF("b", "words_b"), "b").join(found.toDF("a", "words_a"), "a")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(arrow_batches(similar), LINKS)


def confirmed_stars(pairs: DataFrame, docs: DataFrame, p: NearDedup) -> DataFrame:
    """Those pairs (a, b, n) whose full sets are similar enough, where very many members a may share a leader b.

    The members of a leader, with sets of n shingles, are dealt into parts of bounded size. A leader's set is sent once to each part, and
    each member's set once: a row never carries both. ``pairs`` is a cut table, in which a member comes once.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.greatest(F.count(F.lit(1)) / p.block_rows, F.sum("n") * 8 / p.block_bytes)).cast("long").alias("parts"))
    parts = cut(parts, "star-parts")
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "star-ids")
    sets = cut(word_sets(docs, ids, p), "star-sets")
    dealt = pairs.join(small(parts), "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.col("a").alias("doc_id"))
    members = dealt.join(sets, "doc_id").select("b", "part", "doc_id", "words")
    leaders = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("doc_id")).join(sets, "doc_id").select("b", "part", "doc_id", "words")

    def compare(table: pa.Table) -> pa.Table:
        ids, b = table.column("doc_id").to_numpy(), table.column("b").to_numpy()
        words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        lead = words[int(np.flatnonzero(ids == b)[0])]
        found = np.array([i != x and _similar(w, lead, p) for w, i, x in zip(words, ids, b, strict=True)], bool)
        return pa.table({"a": pa.array(ids[found]), "b": pa.array(b[found])})

    return members.union(leaders).groupBy("b", "part").applyInArrow(compare, LINKS)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds: each links the neighbours of a node to the smallest of them, until nothing
    changes. Minima are aggregated before the shuffle; those of nodes that very many links share are broadcast to their links, so
    no task gets all links of a node.
    """
    spark, before = links.sparkSession, None
    with scope(spark):
        edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
        while True:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
            large = cut(with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b"), "large-star")
            least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
            star = with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
            edges = cut(star, "links")
            now = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20)), F.bit_xor(F.xxhash64("b", "a"))).first()
            if now == before:
                return cut(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "components", keep=True)
            before = now


#: A node with more links gets its minimum by broadcast: there are at most 1 / HUB as many such nodes as links.
HUB = 1000


def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (a, b) with ``m`` of the cut table ``least`` (a, m, n), where n counts the rows of a."""
    hubs = least.where(F.col("n") > HUB).select("a", "m")
    if not hubs.limit(1).count():
        return rows.join(least.select("a", "m"), "a")
    few = rows.join(small(hubs.select("a")), "a", "left_anti").join(least.select("a", "m"), "a")
    return few.unionByName(rows.join(small(hubs), "a"))


LINKS = "a long, b long"


def word_sets(docs: DataFrame, ids: DataFrame, p: NearDedup) -> DataFrame:
    """(doc_id, words): the sorted shingle hashes, as bytes, of the documents that the cut table ``ids`` (doc_id) names."""

    def sets(batch: pa.RecordBatch):
        made = [hashes.tobytes() for _, hashes in shingle_sets(batch.column("text"), p.words)]
        at = 0
        while at < len(made):  # a batch of sets stays within a few MB
            j, size = at, 0
            while j < len(made) and (j == at or size + len(made[j]) <= 8_000_000):
                size += len(made[j])
                j += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, j - at), pa.array(made[at:j], pa.binary())], names=["doc_id", "words"])
            at = j

    texts = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    return texts.mapInArrow(arrow_batches(sets), "doc_id long, words binary")


def _similar(x: np.ndarray, y: np.ndarray, p: NearDedup) -> bool:
    """Whether sorted sets are similar enough."""
    few, many = min(len(x), len(y)), max(len(x), len(y))
    if 100 * few < p.similar * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= p.similar * (few + many - both)


def close_signatures(p: NearDedup):
    """For a block's signatures a function of a row and others: those of them that may be similar to it, the nearest first."""

    def close(table: pa.Table):
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)

        def of(x: int, others: np.ndarray) -> np.ndarray:
            far = (sig[others] != sig[x]).sum(axis=1)
            near = np.flatnonzero(far <= p.most)
            return others[near[np.argsort(far[near], kind="stable")]]

        return of

    return close


def links_in_blocks(members: DataFrame, classes: DataFrame, docs: DataFrame, p: NearDedup, close=None) -> DataFrame:
    """Links (a, b) that, with those that made the groups, connect what is connected within each cluster.

    ``classes``: rep, n_shingles, sig. ``close`` tells from the signatures of a block (n_shingles and sig) which rows to compare in full.
    ``members`` (rep, cluster, group) is cut. A group of a block's size or more fills blocks of its own, smaller ones share blocks, and
    two blocks of one large group aren't compared.
    """
    sizes = members.join(classes.select("rep", "n_shingles"), "rep").groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    own = F.when((F.col("n") >= p.block_rows) | (8 * F.col("s") >= p.block_bytes), F.col("group")).otherwise(F.lit(-1))
    shares = cut(sizes.withColumn("own", own), "groups")
    parts = shares.groupBy("cluster", "own").agg(F.ceil(F.greatest(F.sum("n") / p.block_rows, F.sum("s") * 8 / p.block_bytes)).cast("long").alias("parts"))
    parts = cut(parts, "parts")
    blocks = parts.select("cluster", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("cluster", F.struct("own", "part").alias("block"))
    i, j = blocks.select("cluster", F.col("block").alias("i")), blocks.select("cluster", F.col("block").alias("j"))
    pairs = cut(i.join(j, "cluster").where((F.col("i") <= F.col("j")) & ((F.col("i.own") != F.col("j.own")) | (F.col("i.own") == -1))), "block-pairs")

    rows = members.join(shares.select("cluster", "group", "own"), ["cluster", "group"]).join(parts, ["cluster", "own"])
    rows = rows.select("cluster", "rep", "group", F.struct("own", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part")).alias("block"))
    ids = cut(rows.join(pairs.select("cluster", F.explode(F.array("i", "j")).alias("block")).distinct(), ["cluster", "block"], "left_semi").select(F.col("rep").alias("doc_id")), "block-ids")
    rows = rows.join(classes.select("rep", "n_shingles", "sig"), "rep").join(word_sets(docs, ids, p).withColumnRenamed("doc_id", "rep"), "rep")
    left = rows.join(pairs, (rows["cluster"] == pairs["cluster"]) & (rows["block"] == pairs["i"])).select(rows["cluster"], "i", "j", F.lit(True).alias("left"), "rep", "group", "n_shingles", "sig", "words")
    right = rows.join(pairs, (rows["cluster"] == pairs["cluster"]) & (rows["block"] == pairs["j"])).where("i <> j").select(rows["cluster"], "i", "j", F.lit(False).alias("left"), "rep", "group", "n_shingles", "sig", "words")

    def compare(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        near = (close or close_signatures(p))(table)
        words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        first = table.column("left").to_numpy()
        left = np.flatnonzero(first)
        right = left if len(left) == len(rep) else np.flatnonzero(~first)
        _, at, back = np.unique(table.column("group").to_numpy(), return_index=True, return_inverse=True)
        root = at[back].tolist()  # a group is connected from the start

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for x in left.tolist():
            for y in near(x, right).tolist():
                if (right is left and y <= x) or find(x) == find(y) or not _similar(words[x], words[y], p):
                    continue
                root[find(x)] = find(y)
                found.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return left.union(right).groupBy("cluster", "i", "j").applyInArrow(compare, LINKS)


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of ``docs`` (doc_id long, text string; other columns are ignored).

    Null and empty texts have no shingles and are linked with nothing; texts under ``p.words`` words are one shingle. A component's
    first row, by doc_id, then by a hash of the text, gives ``component_id`` its doc_id, and it alone is ``kept``. Rows that repeat a doc_id
    and rows without one (they come last, and may give a null component_id) are documents of their own. An empty table gives an empty
    result; a very long text is one set like any other.
    """
    docs, new = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    names, docs = docs.select("doc_id", "named"), docs.select("doc_id", "text")
    base = cut(signatures(docs, p), "signatures")
    with scope(docs.sparkSession):
        classes = cut(base.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "classes")
        keys = bucket_keys(classes, p)
        many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1")
        shared = cut(keys.join(many, "key"), "buckets")

        large = shared.where((F.col("n") > p.listed) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b"))
        clusters = components(large)
        clusters = clusters.union(clusters.select("component", "component").distinct()).toDF("rep", "cluster")
        leaders = large.groupBy("a").agg(F.min("b").alias("b")).join(classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n")), "a")
        led = cut(confirmed_stars(cut(leaders.select("a", "b", "n"), "leaders"), docs, p), "led")
        members = clusters.join(components(led).toDF("rep", "group"), "rep", "left").select("rep", "cluster", F.coalesce("group", "rep").alias("group"))
        members = cut(members, "members")
        inside = cut(links_in_blocks(members, classes, docs, p), "block-links")

        listed = shared.where(F.col("n") <= p.listed).join(members, "rep", "left").select("key", "rep", "cluster")
        other = listed.select("key", F.col("rep").alias("a"), F.col("cluster").alias("cluster_a"))
        pairs = listed.join(other, "key").where("rep > a and (cluster is null or cluster_a is null or cluster <> cluster_a)").select("a", F.col("rep").alias("b"))
        pairs = cut(near_signatures(pairs.distinct(), classes, p), "near")
        found = components(led.union(inside).union(confirmed(pairs, docs, p)))
        of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
        of_class = cut(of_class, "components-of-classes", keep=True)
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["n_shingles", "h1", "h2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if new:
        out = out.join(names.toDF("component_id", "component"), "component_id").join(names, "doc_id").select(F.col("named").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
    return out
