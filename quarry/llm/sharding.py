"""Sharding by minimax contiguous partition (DataFrame functions only).

Equal texts belong together: they have one place in the order, by a 64-bit hash of the text. The order is cut into ``UNITS`` ranges of
the hash, the atomic groups, whose sizes are summed. Over these sizes the smallest capacity is searched by halving: a capacity is
feasible if filling shards greedily, in order, needs no more than the number of shards. The groups are cut where the greedy filling
with the smallest feasible capacity cuts. The number of groups is fixed, so neither the search nor its table grows with the data.
So the capacity is the smallest for whole ranges: cutting within one, between texts, could save one range's size (a 32768th of the
data, or the size of its largest set of equal texts) at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import cut

UNITS = 32768
#: Rows of one atomic group are numbered in so many parts, as a third of all rows may hold one text.
PARTS = 64


def _needed(sizes: Column, capacity: Column) -> Column:
    """Shards that greedy filling needs."""
    start = F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("load"))

    def put(s: Column, x: Column) -> Column:
        over = s["load"] + x > capacity
        return F.struct(F.when(over, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(over, x).otherwise(s["load"] + x).alias("load"))

    return F.aggregate(sizes, start, put, lambda s: s["n"])


def cuts(sizes: DataFrame, shards: int) -> list[int]:
    """The first units of the shards after the first, from (unit, size) of at most ``UNITS`` rows: contiguous, the largest shard as
    small as can be. What comes to the driver are under ``shards`` numbers."""
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("unit", "size"))).alias("units")).where(F.size("units") > 0)
    one = cut(one.select("units", F.transform("units", lambda u: u["size"]).alias("sizes")), "units")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct(F.greatest(F.array_max("sizes"), F.ceil(total / shards)).alias("low"), total.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2)
        fits = F.when(s["low"] < s["high"], _needed(F.col("sizes"), middle) <= shards)
        return F.when(fits, F.struct(s["low"].alias("low"), middle.alias("high"))).when(~fits, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(s)

    one = one.withColumn("capacity", F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve, lambda s: s["low"]))
    empty = F.struct(F.lit(0).cast("long").alias("load"), F.array().cast("array<int>").alias("firsts"))

    def fill(s: Column, x: Column) -> Column:
        over = s["load"] + x["size"] > F.col("capacity")
        return F.struct(F.when(over, x["size"]).otherwise(s["load"] + x["size"]).alias("load"), F.when(over, F.concat(s["firsts"], F.array(x["unit"]))).otherwise(s["firsts"]).alias("firsts"))

    row = one.select(F.aggregate("units", empty, fill, lambda s: s["firsts"]).alias("firsts")).first()
    return list(row["firsts"]) if row else []


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of ``docs`` (doc_id, text; others are ignored), law ``bytes``.

    A document's size is its UTF-8 bytes plus 8; a null text counts as empty. Equal texts get one shard. Slots number a shard's rows
    without gaps, by atomic group, part of it, hash and doc_id; rows with equal doc_id and text are numbered in any order. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    rows = rows.withColumn("unit", (F.shiftrightunsigned("__hash", 49)).cast("int")).withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    rows = cut(rows, "shard-rows")
    firsts = cuts(rows.groupBy("unit").agg(F.sum("size").alias("size")), shards)
    shard = sum((F.when(F.col("unit") >= u, 1).otherwise(0) for u in firsts), F.lit(0))
    placed = rows.withColumn("shard", shard)
    counts = placed.groupBy("shard", "unit", "__part").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("shard").orderBy("unit", "__part")
    before = counts.withColumn("__before", F.sum("n").over(order) - F.col("n")).drop("n", "shard")
    inside = W.partitionBy("unit", "__part").orderBy("__hash", "doc_id")
    numbered = placed.withColumn("__nth", F.row_number().over(inside) - 1).join(before, ["unit", "__part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
