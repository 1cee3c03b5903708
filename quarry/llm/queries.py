"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import clustering
from quarry.llm.common import table
from quarry.llm.line_dedup import LineDedup, dedup_lines
from quarry.llm.licences import licences
from quarry.llm.licences import oracle_sql as licences_sql
from quarry.llm.mixing import mixed
from quarry.llm.mixing import oracle_sql as mixing_sql
from quarry.llm.near_dedup import NearDedup, near_duplicates
from quarry.llm.ngram_join import NgramJoin, ngram_components
from quarry.llm import secrets, spelling
from quarry.llm.packing import packed
from quarry.llm.quality import ORACLE_SQL as QUALITY_SQL
from quarry.llm.quality import quality
from quarry.llm.sharding import sharded
from quarry.llm.warc import archived_pages
from quarry.llm.webp import media_report, to_media

WORDS_SQL = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at Jaccard similarity 0.85 or more on 5-word shingles. Null and empty texts are alone; equal rows share a component. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    found = near_duplicates(table(spark, sf_dir, "documents"), NearDedup(words=5, similar=85))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an equal or near-equal earlier line makes superfluous. Null texts stay null; rows that repeat a doc_id are their own. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), LineDedup(min_words=3, fuzzy_words=8))


OP2_SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(ls) + 1)) AS i FROM documents)),
w AS MATERIALIZED (SELECT doc_id, pos, line, {WORDS_SQL.format("lower(line)")} AS ws FROM l),
d AS MATERIALIZED (SELECT ws, len(ws) AS n, min((doc_id, pos)) AS first FROM w WHERE len(ws) >= 3 GROUP BY ws),
f AS MATERIALIZED (SELECT *, ws[1] || ' ' || ws[2] AS head, ws[n - 1] || ' ' || ws[n] AS tail FROM d WHERE n >= 8),
p AS (SELECT a.first AS x, a.ws AS u, b.ws AS v FROM f a JOIN f b ON a.head = b.head AND a.n BETWEEN b.n - 1 AND b.n + 1 AND b.first < a.first
      UNION ALL SELECT a.first, a.ws, b.ws FROM f a JOIN f b ON a.tail = b.tail AND a.n BETWEEN b.n - 1 AND b.n + 1 AND b.first < a.first),
e AS (SELECT x, u, v, coalesce(list_position(list_transform(range(1, greatest(len(u), len(v)) + 1), lambda i: u[i] IS DISTINCT FROM v[i]), true), 0) AS k FROM p),
g AS (SELECT DISTINCT x FROM e WHERE (len(u) = len(v) AND u[k + 1:] = v[k + 1:]) OR (len(u) = len(v) + 1 AND u[k + 1:] = v[k:]) OR (len(u) + 1 = len(v) AND u[k:] = v[k + 1:])),
k AS (SELECT w.doc_id, w.pos, w.line, len(w.ws) < 3 OR ((w.doc_id, w.pos) = d.first AND g.x IS NULL) AS stays
      FROM w LEFT JOIN d ON w.ws = d.ws AND len(w.ws) >= 3 LEFT JOIN g ON d.first = g.x)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped FROM k GROUP BY doc_id
"""

def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as gzip members of WARC archives and read back by the salvage reader, also from a copy in which every 13th is damaged. A null html is empty; equal rows are all records. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return archived_pages(table(spark, sf_dir, "pages"), damage=F.col("page_id") % 13 == 5)


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, 0::BIGINT AS gap_before, page_id % 13 <> 5 AS salvaged FROM p LEFT JOIN f USING (d)
"""


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the licences that rules read from them. Null and empty texts have none; equal rows have equal answers. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return licences(table(spark, sf_dir, "documents"))


#: Target weights of the sources; any other source shares the rest.
WEIGHTS = {"src0": 20, "src1": 9, "src2": 8, "src3": 7, "src4": 6, "src5": 5, "src6": 5, "src7": 5} | {f"src{i}": 3 for i in range(8, 19)}
OTHER, BLOCK_BYTES, SEED = 2, 65536, 17


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot, release, deadline and place of each document in the mix. Null texts count as one byte; equal rows have equal places. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS, OTHER, BLOCK_BYTES, SEED)


def op10_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of nearly equal bytes, equal texts together. Null texts count as empty; equal rows get slots of their own. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return sharded(table(spark, sf_dir, "documents"), shards=24)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets by pattern and by character models. Null and empty texts have none; equal rows have equal answers. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return secrets.secret_report(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lossless WebP images, decoded again: digests and features. Null texts are empty; equal texts have equal streams. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return media_report(to_media(table(spark, sf_dir, "documents")))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdicts of the quality rules. Null and empty texts have no words and aren't kept; equal rows have equal answers. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return quality(table(spark, sf_dir, "documents"))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in windows of 2048. Null and empty texts are the end id alone; equal rows are packed each. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return packed(table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds. Vectors that aren't 64 finite numbers are left out; equal rows have equal answers. An empty table gives an empty result; clashing columns are no special case."""
    return clustering.clusters(table(spark, sf_dir, "embeddings"), clustering.Clustering())


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at Jaccard similarity 0.9 or more on 3-word shingles, exactly. Null and empty texts are alone; equal rows share a component. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return ngram_components(table(spark, sf_dir, "documents"), NgramJoin(words=3, similar=90))


OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""

#: A run of letters is misspelt where this divides its hash.
TYPOS = 31


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, misspelt in places, with the frequent word one edit away. Null and empty texts have no words; equal rows count each. An empty table gives an empty result; very long texts and clashing columns are no special case."""
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), typos=TYPOS))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_licence_scan": op4_licence_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_lossless_webp": op6_lossless_webp,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_secret_scan": op8_secret_scan,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_minimax_sharding": op10_minimax_sharding,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_warc_salvage": OP3_SQL,
    "op4_licence_scan": licences_sql(),
    "op5_source_mixing": mixing_sql(WEIGHTS, OTHER, BLOCK_BYTES, SEED),
    "op7_quality_cascade": QUALITY_SQL,
    "op8_secret_scan": secrets.oracle_sql(secrets.sample_weights()),
    "op11_centroid_clustering": clustering.oracle_sql(),
    "op12_ngram_jaccard_join": OP12_SQL,
    "op13_spelling_variants": spelling.oracle_sql(typos=TYPOS),
}
