"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs; all but the last
return the columns of documents. The mixing stage sorts, so its files hold the mix in order of file and row; the packing stage goes along
that order, and its sequences are numbered along the mix.

In every stage rows without a doc_id, and rows that repeat one, are documents of their own; null texts count as empty; other columns than
those of documents are left out; an empty table gives an empty one; a very long text is one row like any other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, numbered, remove, scope, shared_path, small, table, words_of
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.mixing import mixed
from quarry.llm.near_dedup import NearDedup, near_duplicates
from quarry.llm.packing import packed_in_order
from quarry.llm.quality import quality
from quarry.llm.queries import BLOCK_BYTES, OTHER, SEED, WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words, so they go; of equal rows all stay or go, whether they have
    a doc_id or not. An empty table gives an empty one; a very long text is judged whole."""
    return quality(docs.select(*COLUMNS), carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, by (doc_id, line); n_chars is counted anew. A document of which no word is left goes.
    Null and empty texts stay as they are; rows that repeat a doc_id, or have none, are documents of their own; an empty table gives an empty one."""
    out = dedup_lines(docs.select(*COLUMNS)).where((F.col("n_dropped") == 0) | (F.size(words_of(F.col("text"))) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (also of equal rows) the document with the smallest doc_id. Texts are shuffled only if very many go.
    Null and empty texts are copies of nothing and stay; rows without a doc_id come last; an empty table gives an empty one; a very long text is one set."""
    docs, new = numbered(docs.select(*COLUMNS))
    with scope(spark):
        copies = cut(near_duplicates(docs, NearDedup(words=5, similar=80)).where("not kept").select("doc_id"), "copies", keep=True)
    rest = docs.join(small(copies), "doc_id", "left_anti")
    return (rest.withColumn("doc_id", F.col("named")) if new else rest).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, over all partitions. Rows with equal places, as repeated ones, stand side by side.
    Null texts count one byte; rows without a source share the lane of the others; an empty table gives an empty one; a very long text stays whole."""
    rows = mixed(docs.select(*COLUMNS), WEIGHTS, OTHER, BLOCK_BYTES, SEED, with_text=True)
    return rows.sort("slot", "place", "doc_id").select(*COLUMNS)


def read_from_files(docs: DataFrame) -> bool:
    """Rows know their files; only the plan is looked at."""
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; sequence_id follows the order of the files' rows.

    A table that isn't read from files goes in the order of its partitions. Null and empty texts are the end id alone; rows that repeat a
    doc_id, or have none, are packed each; a very long text is cut into as many pieces as it needs; an empty table gives an empty one.
    """
    if read_from_files(docs):
        name = F.col("_metadata.file_name")
        number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long"), F.lit(0))
        part, row = number("part-([0-9]+)") * 1_000_000 + number("-c([0-9]+)[.]"), F.col("_metadata.row_index")
    else:
        part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = docs.select("doc_id", "text", part.cast("long").alias("part"), row.alias("row"))
    return packed_in_order(rows, "part", "row", window=2048, end_id=1)


STAGES = [("quality rules", keep_good), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Sum-of-squares packing goes document by document and tokenises: SQL can't express it. tests/llm hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole documents table. What a stage wrote for itself goes as soon as its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
