"""Spelling variants: words one edit apart, each led to a much more frequent form, found by Bloom-guided neighbourhoods.

The vocabulary goes into blocked Bloom filters, one for each length of words: a word sets a few bits of one 64-bit block. The filters are
broadcast, their size is fixed in advance by a count (four bytes a word, at most ``filter_bytes``; a larger vocabulary is covered by several
rounds of filters, each for a share of the hashes, so they never fill up). Tasks generate the edits of their words as hashes, from hashes
of prefixes and suffixes, without writing the strings, and probe the filter of the edit's length. Only positives are written out, shuffled
and joined with the vocabulary, which removes the filters' false positives. The filters have no false negatives, so nothing is lost.

An edit is looked for once: an insertion is another word's deletion, and of a replacement only the smaller code point is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, mix, scope

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = 0x9E3779B97F4A7C15  # of the rolling hash
SHARDS = 64  # words of 64 code points and more share one filter


@dataclass(frozen=True)
class Spelling:
    letters: str = "A-Za-z\u00c0-\u00ff"  # a word is a run of these
    shortest: int = 7  # code points
    least: int = 2  # occurrences
    ratio: int = 10  # a form is so many times as frequent
    filter_bytes: int = 64_000_000
    tile: int = 1 << 20  # edits that are probed at once


def word_counts(docs: DataFrame, p: Spelling = Spelling(), typos: int | None = None) -> DataFrame:
    """(word, n): the words of ``p.shortest`` code points or more in whole texts, A-Z in lower case, that occur ``p.least`` times in all.

    With ``typos``, a run loses the code point CRC-32 % length where ``typos`` divides the CRC-32 of ``doc_id:run`` (no doc_id: nothing
    before the colon): misspellings whose number grows with the text. Runs are counted in each task before they are shuffled.
    """
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{p.letters}]{{{p.shortest},}}"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if typos:
        rows = rows.withColumn("h", F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % typos == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= p.shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.least)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of a column by length: their rows, and their code points, one word a line."""
    words = column.to_pylist()
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def powers(n: int) -> np.ndarray:
    """BASE to the powers n - 1 down to 0."""
    return np.cumprod(np.concatenate((np.ones(min(n, 1), np.uint64), np.full(max(n - 1, 0), BASE, np.uint64))))[::-1]


def values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line of code points."""
    return (values(points) * powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def bits(x: np.ndarray) -> np.ndarray:
    """The bits that scrambled hashes set in their blocks."""
    one = np.uint64(1)
    out = np.zeros(len(x), np.uint64)
    for k in (0, 6, 12, 18):
        out |= one << ((x >> np.uint64(k)) & np.uint64(63))
    return out


def block(x: np.ndarray, blocks: int) -> np.ndarray:
    """The block of scrambled hashes, by their upper half."""
    return (((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def share(x: np.ndarray, rounds: int) -> np.ndarray:
    """In which round of filters scrambled hashes are."""
    return ((x >> np.uint64(24)) & np.uint64(0xFF)) * np.uint64(rounds) >> np.uint64(8)


def filters(vocabulary: DataFrame, counts: dict[int, int], turn: int, rounds: int) -> dict[int, np.ndarray]:
    """The filters of one round, by length of words: 64-bit blocks, two words a block on average. Tasks and Spark join what words set."""
    sizes = {s: max(1, -(-n // (2 * rounds))) for s, n in counts.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in by_length(batch.column("word")):
                x = mix(hashes(points))
                x = x[share(x, rounds) == turn]
                s = min(points.shape[1], SHARDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s), pa.int32()), pa.array(block(x, sizes[s])), pa.array(bits(x).view(np.int64))], names=["s", "b", "m"])

    out = {s: np.zeros(n, np.uint64) for s, n in sizes.items()}
    for batch in vocabulary.select("word").mapInArrow(of, "s int, b long, m long").groupBy("s", "b").agg(F.bit_or("m").alias("m")).toArrow().to_batches():
        s, b, m = (batch.column(i).to_numpy() for i in range(3))
        for shard in np.unique(s):
            out[shard][b[s == shard]] = m[s == shard].view(np.uint64)
    return out


def edits(points: np.ndarray, alphabet: np.ndarray, tile: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """The deletions of each line, then its replacements by greater code points: their length, lines, places, code points (None: deleted),
    hashes. Of equal neighbours only the last one is deleted, so no edit comes twice."""
    rows, n = points.shape
    value, power = values(points), powers(n)
    part = value * power
    after = np.concatenate((np.cumsum(part[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((rows, 1), np.uint64)), axis=1)  # hashes of what follows
    whole = part.sum(axis=1, dtype=np.uint64)
    before = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(value[:, :-1] * power[1:], axis=1)), axis=1) if n else value  # one place lower
    line, at = np.nonzero(np.concatenate((points[:, 1:] != points[:, :-1], np.ones((rows, 1), bool)), axis=1))
    for i in range(0, len(line), tile):
        a, b = line[i : i + tile], at[i : i + tile]
        yield n - 1, a, b, None, before[a, b] + after[a, b]
    letters = values(alphabet)
    step = max(1, tile // (max(1, rows) * max(1, len(alphabet))))
    for i in range(0, n, step):
        there = points[:, i : i + step]
        made = whole[:, None, None] + (letters[None, None, :] - value[:, i : i + step, None]) * power[None, i : i + step, None]
        line, at, letter = np.nonzero(alphabet[None, None, :] > there[:, :, None])
        yield n, line, at + i, alphabet[letter], made[line, at, letter]


def positives(vocabulary: DataFrame, alphabet: np.ndarray, found, turn: int, rounds: int, p: Spelling) -> DataFrame:
    """(word, n, edit): the edits that a round's filters (a broadcast) don't rule out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = found.value
        for batch in batches:
            for rows, points in by_length(batch.column("word")):
                for first in range(0, len(rows), 256):
                    some = points[first : first + 256]
                    for n, line, at, letter, made in edits(some, alphabet, p.tile):
                        blocks = shards.get(min(n, SHARDS))
                        if blocks is None:
                            continue
                        x = mix(made)
                        m = bits(x)
                        hit = np.flatnonzero(((blocks[block(x, len(blocks))] & m) == m) & (share(x, rounds) == turn))
                        if not len(hit):
                            continue
                        strings = []
                        for h in hit.tolist():
                            w, i = some[line[h]], int(at[h])
                            middle = [] if letter is None else [letter[h]]
                            strings.append(np.concatenate((w[:i], np.array(middle, np.uint32), w[i + 1 :])).astype("<u4").tobytes().decode("utf-32-le"))
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows[first + line[hit]])) for c in ("word", "n")] + [pa.array(strings, pa.string())], names=["word", "n", "edit"])

    return vocabulary.select("word", "n").mapInArrow(of, "word string, n long, edit string")


def near_words(vocabulary: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """(a, n_a, b, n_b): every two words of the vocabulary (word, n) that are one edit apart, once. ``vocabulary`` is a stored table."""

    def points_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in by_length(batch.column("word")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(points).astype(np.int64))], names=["c"])

    spark = vocabulary.sparkSession
    counts = {r["s"]: r["n"] for r in vocabulary.groupBy(F.least(F.length("word"), F.lit(SHARDS)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = vocabulary.select("word").mapInArrow(points_of, "c long").distinct()
    alphabet = np.sort(np.array([r["c"] for r in letters.collect()], np.uint32))  # at most the code points there are
    rounds = min(256, max(1, -(-4 * sum(counts.values()) // p.filter_bytes)))
    out = None
    for turn in range(rounds):
        found = spark.sparkContext.broadcast(filters(vocabulary, counts, turn, rounds))
        some = positives(vocabulary, alphabet, found, turn, rounds, p)
        out = some if out is None else out.union(some)
    exact = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("n_b"))
    return out.join(exact, "edit").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edit").alias("b"), "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word reached along the forms, each of which is more frequent. Ways double in each round."""
    rows = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = rows.join(rows.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        if not further.limit(1).count():
            return rows
        rows = cut(rows.join(further.select("word", "next"), "word", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(counts: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``counts`` (word, n; other columns are ignored).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word with the
    largest n (ties: the smallest in code-point order), if that is ``p.ratio`` times its own at least, else null; its root is the last word
    along the forms, itself without one. Rows without a word or a count are left out; counts of repeated words are added up; an empty
    table gives an empty result; a word of any length is one like any other.
    """
    words = counts.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).dropna()
    vocabulary = cut(words.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary", keep=True)
    with scope(counts.sparkSession):
        pairs = cut(near_words(vocabulary, p), "near-words")
        both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
        both = both.union(pairs.select("b", "n_b", "a", "n_a"))
        near = both.groupBy("word").agg(F.any_value("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
        leads = -F.col("best.m") >= p.ratio * F.col("n")
        near = near.select("word", "n_near", F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n"))
        near = cut(near, "near-counts", keep=True)
        ends = cut(roots(near.where("form is not null")), "word-roots", keep=True)
    out = vocabulary.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


#: CRC-32 of a text in SQL: ``crc_table`` is a CTE with the 256 steps of a byte; the rest runs over the text's bytes in hexadecimal.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def crc_sql(text: str) -> str:
    digits = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


def oracle_sql(p: Spelling = Spelling(), typos: int = 31) -> str:
    """The same for DuckDB: words that share what is left without one code point are compared."""
    letters = p.letters.replace("\u00c0", "\\x{C0}").replace("\u00ff", "\\x{FF}")
    return f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{letters}]{{{p.shortest},}}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT run, k, {crc_sql("named")} AS h FROM r, crc_table),
w AS (SELECT CASE WHEN h % {typos} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {p.shortest} GROUP BY word HAVING sum(k) >= {p.least}),
d AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS MATERIALIZED (SELECT a.word AS x, b.word AS y, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.d = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.d = v.word),
g AS MATERIALIZED (SELECT x, count(*) AS n_near, max(m) AS m, arg_min(y, (-m, y)) AS y FROM e GROUP BY x),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {p.ratio} * n THEN y END AS form, CASE WHEN m >= {p.ratio} * n THEN m END AS form_n FROM v LEFT JOIN g ON x = word),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word) JOIN f o ON t.root = o.word WHERE o.form IS NULL
"""
