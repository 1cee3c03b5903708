"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sizes of sets fall into bands so narrow that similar sets lie in one band or in two neighbours. In a band two similar sets differ in at most
H tokens. The universe of tokens is hashed into H + 1 segments, anew for each band: then two similar sets have equal subsets in some
segment. Each set files the subsets of its segments for its own band (where it can be found and looks itself) and for the band below
(where it only looks, as the larger one of a pair). Pairs that share a subset are candidates.

Where a subset is common, this costs too much. The allocation of the H + 1 permitted differences is changed then, by cost: a set may skip its
common segments if it looks in as many others for subsets that differ in up to one token, by one-deletion neighbourhoods: a segment
without one token is looked for among whole segments, and a whole one among those of others without one token. What these look-ups would
find is counted first; a common subset is given up only if all sets with it can skip it, each for fewer than ``most_found`` candidates. Only
sets that share a common subset need neighbourhoods: a similar pair without one meets in another segment anyway.

The common subsets that are left belong to groups of near copies. Each member is compared with its group's leader, and what a leader
doesn't connect is compared in blocks of bounded size. So the pairs of a group are never listed.

Before sets are compared in full, their sketches are: token hashes set bits by parity, so the sketches of two sets differ in at most as
many bits as the sets differ in tokens. That rules out pairs, never a similar one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_batches, cut, mix, numbered, scope, signed, small, text_pieces
from quarry.llm.near_dedup import components, confirmed, confirmed_stars, links_in_blocks, shingle_sets


@dataclass(frozen=True)
class NgramJoin:
    words: int = 3
    similar: int = 90  # hundredths
    listed: int = 16  # sets with a subset whose pairs are listed
    most_skipped: int = 4  # common segments that a set may skip
    most_found: int = 64  # candidates for which it may
    block_rows: int = 1024
    block_bytes: int = 8_000_000


def bands(p: NgramJoin) -> tuple[np.ndarray, np.ndarray]:
    """The smallest size of each band, and its number of segments (0 where only equal sets are similar)."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1], low[-1] * 100 // p.similar) + 1)
    low = np.array(low, np.int64)
    most = (low[1:] - 1) * (100 - p.similar) // p.similar
    return low[:-1], np.where(most > 0, most + 1, 0)


def band_of(sizes: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.searchsorted(low, sizes, side="right") - 1


def segments(tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, count: np.ndarray):
    """The subsets of sets in the segments of their bands.

    ``tokens`` of all sets, the set each belongs to (``owner``), and for each set its band and number of segments. Gives for each token
    its slot, the hash it adds to the slot's sum, and for all slots (those of a set stand together): sums, salts and numbers of tokens.
    """
    x = mix(tokens ^ mix(band.astype(np.uint64) + np.uint64(1))[owner])
    seg = ((x >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)
    first = np.cumsum(count) - count
    slot = first[owner] + seg.astype(np.int64)
    add = mix(x + np.uint64(0x632BE59BD9B4E019))
    total = int(count.sum())
    sums, n = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
    np.add.at(sums, slot, add)
    place = np.arange(total) - np.repeat(first, count)
    salt = mix((np.repeat(band, count).astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
    return slot, add, sums, salt, n


def whole_key(sums: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Key of a subset in its segment and band."""
    return mix(sums ^ salt)


def less_key(sums: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Key of a subset under which those with one token more are filed."""
    return mix(~mix(sums ^ salt))


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each hash value, set if an odd number of tokens has it; about two bits a token, a power of two from 64 to 65536."""
    size = 1 << min(16, max(6, int(2 * len(tokens) - 1).bit_length()))
    at = (mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a line, as 64-bit words) at a smaller width: halves are added up modulo 2."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def may_be_similar(x: np.ndarray, y: np.ndarray, far: np.ndarray, p: NgramJoin) -> np.ndarray:
    """Whether sets of x and y tokens of which ``far`` at least differ can be similar."""
    return (100 * np.minimum(x, y) >= p.similar * np.maximum(x, y)) & ((100 + p.similar) * far <= (100 - p.similar) * (x + y))


def close_sketches(p: NgramJoin):
    """For a block's sketches a function of a row and others: those of them that may be similar to it, the nearest first."""

    def close(table: pa.Table):
        n, made = table.column("n_shingles").to_numpy(), table.column("sig").to_pylist()
        width = np.array([len(s) // 8 for s in made])
        at, levels = np.zeros(len(made), np.int64), {}
        for w in np.unique(width):
            rows = np.flatnonzero(width >= w)
            place = np.zeros(len(made), np.int64)
            place[rows] = np.arange(len(rows))
            bits = np.empty((len(rows), w), np.uint64)
            for v in np.unique(width[rows]):
                some = np.flatnonzero(width == v)
                bits[place[some]] = folded(matrix([made[i] for i in some]), w)
            levels[int(w)] = (place, bits)

        def of(x: int, others: np.ndarray) -> np.ndarray:
            far = np.zeros(len(others), np.int64)
            shared = np.minimum(width[others], width[x])
            for w in np.unique(shared):
                place, bits = levels[int(w)]
                mine = shared == w
                far[mine] = np.bitwise_count(bits[place[others[mine]]] ^ bits[place[x]]).sum(axis=1)
            near = np.flatnonzero(may_be_similar(n[others], n[x], far, p))
            return others[near[np.argsort(far[near], kind="stable")]]

        return of

    return close


def digests(docs: DataFrame, p: NgramJoin) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of each text's set."""

    def of(batch: pa.RecordBatch):
        n, h1, h2 = [], [], []
        for _, tokens in shingle_sets(batch.column("text"), p.words):
            n.append(len(tokens))
            h1.append(np.add.reduce(tokens, dtype=np.uint64))
            h2.append(np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(np.array(h1, np.uint64))), pa.array(signed(np.array(h2, np.uint64)))], names=["doc_id", "n_shingles", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(of), "doc_id long, n_shingles long, h1 long, h2 long")


def sets_of(column: pa.Array, p: NgramJoin):
    """Rows [i, j) of a column with the tokens of all their sets and their sizes, a bounded number of bytes at a time."""
    for i, j, _, _ in text_pieces(column):
        sets = [tokens for _, tokens in shingle_sets(column.slice(i, j - i), p.words)]
        yield i, j, np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def lists(flat: np.ndarray, count: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat, kind))


FILED = "rep long, n_shingles long, sig binary, own array<long>, below array<long>"


def filed(docs: DataFrame, reps: DataFrame, p: NgramJoin) -> DataFrame:
    """For the documents that the cut table ``reps`` (rep) names: size, sketch, and the keys of the subsets in the segments of their own band
    and of the band below, in order of the segments."""
    low, segs = bands(p)

    def of(batch: pa.RecordBatch):
        for i, j, tokens, sizes in sets_of(batch.column("text"), p):
            owner, band = np.repeat(np.arange(j - i), sizes), band_of(sizes, low)
            ends = np.cumsum(sizes)
            columns = [batch.column("rep").slice(i, j - i), pa.array(sizes), pa.array([sketch(tokens[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())]
            for level in (band, np.maximum(band - 1, 0)):
                count = segs[level]
                some = count[owner] > 0
                _, _, sums, salt, _ = segments(tokens[some], owner[some], level, count)
                columns.append(lists(signed(whole_key(sums, salt)), count))
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n_shingles", "sig", "own", "below"])

    texts = docs.join(small(reps.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    return texts.mapInArrow(arrow_batches(of), FILED)


def neighbourhoods(docs: DataFrame, asked: DataFrame, p: NgramJoin) -> DataFrame:
    """(files, own, rep, n, key): what sets file and look up when they skip segments.

    ``asked`` (rep, files, skip_own, skip_below) is cut. With ``files`` a set files the subsets of its own band's segments, whole and less one
    token each. In a band with a list of segments to skip it looks for as many others, the fullest ones, up to one token.
    """
    low, segs = bands(p)

    def of(batch: pa.RecordBatch):
        files = batch.column("files").to_pylist()
        skips = {True: batch.column("skip_own").to_pylist(), False: batch.column("skip_below").to_pylist()}
        for i, j, tokens, sizes in sets_of(batch.column("text"), p):
            ends, out = np.cumsum(sizes), []
            for r in range(i, j):
                mine = tokens[ends[r - i] - sizes[r - i] : ends[r - i]]
                for own, level in ((True, 0), (False, 1)):
                    band = band_of(sizes[r - i : r - i + 1], low) - level
                    skip = skips[own][r]
                    if not (skip or (own and files[r])) or band[0] < 0 or not segs[band[0]]:
                        continue
                    slot, add, sums, salt, n = segments(mine, np.zeros(len(mine), np.int64), band, segs[band])
                    less = sums[slot] - add
                    if own and files[r]:
                        out += [(True, own, r, whole_key(sums, salt)), (True, own, r, less_key(less, salt[slot]))]
                    if skip:
                        n[np.array(skip)] = -1
                        some = np.argsort(-n, kind="stable")[: len(skip)]
                        one = np.isin(slot, some)
                        # equal subsets are found by their whole keys already
                        out += [(False, own, r, less_key(sums[some], salt[some])), (False, own, r, whole_key(less[one], salt[slot[one]]))]
            if out:
                count = [len(k) for *_, k in out]
                row = np.repeat([r for _, _, r, _ in out], count)
                columns = [pa.array(np.repeat([f for f, *_ in out], count)), pa.array(np.repeat([o for _, o, *_ in out], count)), batch.column("rep").take(pa.array(row)), pa.array(sizes[row - i])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(signed(np.concatenate([k for *_, k in out])))], names=["files", "own", "rep", "n", "key"])

    texts = docs.join(small(asked.withColumnRenamed("rep", "doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), "text", "files", "skip_own", "skip_below")
    return texts.mapInArrow(arrow_batches(of), "files boolean, own boolean, rep long, n long, key long")


def size_fits(a: str, b: str, p: NgramJoin):
    return 100 * F.least(a, b) >= p.similar * F.greatest(a, b)


def reallocated(common: DataFrame, table: DataFrame, docs: DataFrame, p: NgramJoin) -> tuple[DataFrame, DataFrame]:
    """The common subsets that have to stay, and the candidate pairs (a, b) that make up for the others.

    ``common`` (key, rep, own, j, n) are the rows of subsets that very many sets share; ``table`` is that of ``filed``. Both are cut.
    """
    skips = common.groupBy("rep", "own").agg(F.count(F.lit(1)).alias("skipped"), F.slice(F.sort_array(F.collect_list("j")), 1, p.most_skipped).alias("skip"))
    counts = table.select("rep", F.size("own").alias("in_own"), F.size("below").alias("in_below"))
    skips = skips.where(F.col("skipped") <= p.most_skipped).join(counts, "rep").where(2 * F.col("skipped") <= F.when(F.col("own"), F.col("in_own")).otherwise(F.col("in_below")))
    skips = cut(skips.select("rep", "own", "skip"), "skips")
    marked = common.join(small(skips.withColumn("can", F.lit(True))), ["rep", "own"], "left")
    keys = cut(marked.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count("can").alias("can")).where("rows = can").select("key"), "skipped-keys")
    nothing = common.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    if not keys.count():
        return common, nothing
    rows = cut(common.join(small(keys), "key", "left_semi"), "skipped-rows")
    looks = rows.select("rep", "own").distinct().join(skips, ["rep", "own"])
    asks = looks.select("rep", F.lit(False).alias("files"), F.when(F.col("own"), F.col("skip")).alias("o"), F.when(~F.col("own"), F.col("skip")).alias("b"))
    files = rows.where("own").select("rep", F.lit(True), F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>"))
    asked = asks.union(files).groupBy("rep").agg(F.max("files").alias("files"), F.max("o").alias("skip_own"), F.max("b").alias("skip_below"))
    near = cut(neighbourhoods(docs, cut(asked, "asked"), p), "neighbourhoods")
    held = near.where("files")
    sizes = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("found")), "list-lengths")
    dear = near.where("not files").join(sizes, "key").groupBy("rep", "own").agg(F.sum("found").alias("found")).where(F.col("found") > p.most_found)
    dear = cut(dear.select("rep", "own", F.lit(True).alias("dear")), "dear")
    stay = cut(rows.join(small(dear), ["rep", "own"], "left_semi").select("key").distinct(), "kept-keys")
    gone = cut(keys.join(stay, "key", "left_anti"), "given-up-keys")
    cheap = near.where("not files").join(small(dear.drop("dear")), ["rep", "own"], "left_anti").select("key", F.col("rep").alias("r"), F.col("n").alias("m"))
    pairs = held.join(cheap, "key").where((F.col("rep") != F.col("r")) & size_fits("n", "m", p)).select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b"))
    return cut(common.join(small(gone), "key", "left_anti"), "common-left"), pairs


def near_sketches(pairs: DataFrame, table: DataFrame, p: NgramJoin) -> DataFrame:
    """Those pairs (a, b) that sizes and sketches don't rule out."""

    def of(batch: pa.RecordBatch):
        x, y = (batch.column(c).to_pylist() for c in ("sig_a", "sig_b"))
        width = np.array([min(len(s), len(t)) // 8 for s, t in zip(x, y, strict=True)])
        far = np.zeros(batch.num_rows, np.int64)
        wide = np.array([(len(s), len(t)) for s, t in zip(x, y, strict=True)])
        for a, b in np.unique(wide, axis=0):
            rows = np.flatnonzero((wide[:, 0] == a) & (wide[:, 1] == b))
            w = int(width[rows[0]])
            far[rows] = np.bitwise_count(folded(matrix([x[i] for i in rows]), w) ^ folded(matrix([y[i] for i in rows]), w)).sum(axis=1)
        near = pa.array(may_be_similar(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), far, p))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    of_set = table.select("rep", "n_shingles", "sig")
    both = pairs.join(of_set.toDF("a", "n_a", "sig_a"), "a").join(of_set.toDF("b", "n_b", "sig_b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    return both.mapInArrow(arrow_batches(of), "a long, b long")


def linked(docs: DataFrame, table: DataFrame, p: NgramJoin) -> DataFrame:
    """(id, component) of the sets of the cut table ``table`` (of ``filed``) that are linked with another."""
    keys = table.select("rep", F.col("n_shingles").alias("n"), F.lit(True).alias("own"), F.posexplode("own").alias("j", "key"))
    keys = keys.union(table.select("rep", "n_shingles", F.lit(False), F.posexplode("below")))
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("rep").alias("least"), F.max("own").alias("any")).where("sets > 1 and any").drop("any")
    shared = cut(keys.join(many, "key"), "shared-subsets")

    common = shared.where(F.col("sets") > p.listed)
    common, made_up = reallocated(cut(common, "common-subsets"), table, docs, p)
    star = common.where(F.col("rep") != F.col("least")).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = components(star)
    clusters = clusters.union(clusters.select("component", "component").distinct()).toDF("rep", "cluster")
    leaders = star.groupBy("a").agg(F.min("b").alias("b")).join(table.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n")), "a").select("a", "b", "n")
    led = cut(confirmed_stars(cut(leaders, "leaders"), docs, p), "led")
    members = clusters.join(components(led).toDF("rep", "group"), "rep", "left").select("rep", "cluster", F.coalesce("group", "rep").alias("group"))
    members = cut(members, "members")
    inside = cut(links_in_blocks(members, table.select("rep", "n_shingles", "sig"), docs, p, close_sketches(p)), "block-links")

    listed = shared.where(F.col("sets") <= p.listed).join(members, "rep", "left").select("key", "rep", "own", "n", "cluster")
    other = listed.where("own").select("key", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("cluster").alias("cluster_a"))
    met = (F.col("rep") > F.col("a")) | (~F.col("own") & (F.col("rep") != F.col("a")))
    apart = F.expr("cluster is null or cluster_a is null or cluster <> cluster_a")
    pairs = listed.join(other, "key").where(met & apart & size_fits("n", "m", p)).select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b"))
    pairs = cut(near_sketches(pairs.union(made_up).distinct(), table, p), "near")
    return components(led.union(inside).union(confirmed(pairs, docs, p)))


def ngram_components(docs: DataFrame, p: NgramJoin = NgramJoin()) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs`` (doc_id long, text string; other columns are ignored).

    Texts whose sets of ``p.words``-word shingles have a Jaccard similarity of ``p.similar`` hundredths or more are linked; none is missed.
    Null and empty texts have no shingles and are linked with nothing; texts under ``p.words`` words are one shingle. A component's first row,
    by doc_id, gives ``component_id`` its doc_id. Rows that repeat a doc_id and rows without one (they come last, and may give a null
    component_id) are documents of their own. An empty table gives an empty result; a very long text is one set like any other.
    """
    docs, new = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    names, docs = docs.select("doc_id", "named"), docs.select("doc_id", "text")
    base = cut(digests(docs, p), "digests", keep=True)
    with scope(docs.sparkSession):
        classes = cut(base.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
        found = linked(docs, cut(filed(docs, classes.select("rep"), p), "filed"), p)
        of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
        of_class = cut(of_class, "components-of-classes", keep=True)
    out = base.join(of_class, ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if new:
        out = out.join(names.toDF("component_id", "component"), "component_id").join(names, "doc_id").select(F.col("named").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    return out
