"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's documents, in an order by hash, are cut into blocks of ``block_bytes``. With the weight w of a source as a share of all,
its block j is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot, of the released blocks, the one with the
earliest deadline goes. On one lane this meets all deadlines, so at any slot each source is less than one block from its share.

Weights are whole numbers with sum A, so the schedule repeats every A slots: one period is worked out once, as a fold over A slots, and
block j of a source with weight a takes its place j mod a in period j div a. When a source runs out, its slots stay empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import cut

#: Slices of the hash range of a source; each is numbered by itself, and the numbers continue over them.
SLICES = 4096


def schedule(spark: SparkSession, weights: list[int]) -> DataFrame:
    """One period: (lane, nth, release, due, turn) for the nth block of each lane. Its size is the sum of the weights."""
    a = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    total = F.lit(int(sum(weights))).cast("long")
    lanes = F.sequence(F.lit(0), F.lit(len(weights) - 1))

    def step(state: Column, slot: Column) -> Column:
        def claim(i: Column) -> Column:
            """(deadline, release, lane) of a lane's next block; sorts by the earliest deadline."""
            j, w = F.get(state["done"], i), F.get(a, i)
            return F.struct(F.ceil((j + 1) * total / w).alias("due"), F.floor(j * total / w).alias("release"), i.alias("lane"))

        ready = F.filter(F.transform(lanes, claim), lambda c: (c["release"] <= slot) & (F.get(state["done"], c["lane"]) < F.get(a, c["lane"])))
        best = F.array_min(ready)
        done = F.transform(state["done"], lambda n, i: n + F.when(i == best["lane"], 1).otherwise(0))
        entry = F.struct(best["lane"].cast("int").alias("lane"), F.get(state["done"], best["lane"]).alias("nth"), best["release"].cast("long").alias("release"), best["due"].cast("long").alias("due"), slot.cast("long").alias("turn"))
        return F.struct(done.alias("done"), F.concat(state["out"], F.array(entry)).alias("out"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(weights)).alias("done"), F.array().cast("array<struct<lane:int,nth:bigint,release:bigint,due:bigint,turn:bigint>>").alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda s: s["out"])
    return spark.range(1).select(F.inline(whole))


def mixed(docs: DataFrame, weights: Mapping[str, int], other: int = 1, block_bytes: int = 65536, seed: int = 17, with_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns; text is in the result only ``with_text``) with their place in the mix.

    ``weights``: whole positive weights of named sources; all other sources and null share one lane of weight ``other``. Added
    (long): block, slot, release, due, place (bytes of the lane before the document, so (slot, place, doc_id) sorts the mix).
    A document counts as its UTF-8 bytes plus 1 (null text: 1); a very long one, of several blocks, stays whole and takes the slot of its
    first, so the deviation of less than a block is one of block counts, not of bytes. Rows without
    a doc_id are ordered by their text; rows of a lane that are equal in what orders them have equal places. Columns with these names are
    replaced. An empty table gives an empty result. Only ``with_text`` are texts shuffled, once.
    """
    names = list(weights)
    lane = F.coalesce(*(F.when(F.col("source") == n, F.lit(k)) for k, n in enumerate(names)), F.lit(len(names))) if names else F.lit(0)
    added = ("block", "slot", "release", "due", "place")
    rest = [c for c in docs.columns if (with_text or c != "text") and c not in added]
    order = F.coalesce(*(F.md5(F.concat(F.lit(f"{seed}:{by}:" if by == "text" else f"{seed}:"), F.col(by).cast("string"))) for by in ("doc_id", "text")))
    nested = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__rest")  # so no name of the caller's clashes with ours
    rows = docs.select(nested, F.col("doc_id").alias("__id"), lane.alias("__lane"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("__size"), F.coalesce(order, F.lit("0" * 32)).alias("__order"))
    rows = rows.withColumn("__slice", (F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * SLICES / 2**32).cast("int"))
    rows = rows if with_text else cut(rows, "mix")  # sizes are read twice; texts aren't written for that

    sums = rows.groupBy("__lane", "__slice").agg(F.sum("__size").alias("__sum"))  # at most SLICES rows a lane
    before = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy("__lane").orderBy("__slice")) - F.col("__sum")).drop("__sum")
    # rows with an equal order are peers: what they add is taken off again, so they share a place
    same = W.partitionBy("__lane", "__slice", "__order", "__id")
    placed = rows.withColumn("__upto", F.sum("__size").over(W.partitionBy("__lane", "__slice").orderBy("__order", "__id"))).withColumn("__own", F.sum("__size").over(same))
    placed = placed.join(F.broadcast(before), ["__lane", "__slice"]).withColumn("place", F.col("__before") + F.col("__upto") - F.col("__own"))
    placed = placed.withColumn("block", F.floor(F.col("place") / block_bytes))

    shares = [int(weights[n]) for n in names] + [int(other)]
    period = schedule(docs.sparkSession, shares).withColumnRenamed("lane", "__lane").withColumnRenamed("nth", "__nth")
    total = sum(shares)
    share = F.get(F.array(*(F.lit(s).cast("long") for s in shares)), F.col("__lane"))
    placed = placed.withColumn("__nth", F.col("block") % share).withColumn("__lap", F.floor(F.col("block") / share))
    placed = placed.join(F.broadcast(period), ["__lane", "__nth"])
    lap = F.col("__lap") * total
    return placed.select(*(F.col("__rest").getField(c).alias(c) for c in rest), "block", (lap + F.col("turn")).alias("slot"), (lap + F.col("release")).alias("release"), (lap + F.col("due")).alias("due"), "place")


def oracle_sql(weights: Mapping[str, int], other: int, block_bytes: int, seed: int) -> str:
    """The same for DuckDB, with the slots filled one by one."""
    shares = [*weights.values(), other]
    total, k = sum(shares), len(shares)
    lanes = " ".join(f"WHEN source = '{n}' THEN {i}" for i, n in enumerate(weights))
    claims = f"list_transform(range(0, {k}), lambda i: {{'due': ((done[i + 1] + 1) * {total} + a[i + 1] - 1) // a[i + 1], 'release': (done[i + 1] * {total}) // a[i + 1], 'lane': i}})"
    return f"""
WITH RECURSIVE s AS (
  SELECT 0 AS t, {[0] * k}::BIGINT[] AS done, {shares}::BIGINT[] AS a, NULL::STRUCT(due BIGINT, release BIGINT, lane BIGINT) AS best, 0::BIGINT AS nth
  UNION ALL
  SELECT t + 1, list_transform(done, lambda n, i: n + CASE WHEN i - 1 = b.lane THEN 1 ELSE 0 END), a, b, done[b.lane + 1] FROM
    (SELECT *, list_min(list_filter({claims}, lambda c: c.release <= t AND done[c.lane + 1] < a[c.lane + 1])) AS b FROM s WHERE t < {total})),
period AS (SELECT best.lane AS lane, nth, best.release AS release, best.due AS due, t - 1 AS turn FROM s WHERE t > 0),
d AS (SELECT doc_id, source, CASE {lanes} ELSE {k - 1} END AS lane, strlen(coalesce(text, '')) + 1 AS size, md5('{seed}:' || doc_id) AS ord FROM documents),
p AS (SELECT doc_id, source, lane, (sum(size) OVER (PARTITION BY lane ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM d),
b AS (SELECT *, place // {block_bytes} AS block, {shares}[lane + 1] AS a FROM p)
SELECT doc_id, source, block, (block // a) * {total} + turn AS slot, (block // a) * {total} + release AS release, (block // a) * {total} + due AS due, place
FROM b JOIN period ON b.lane = period.lane AND b.block % a = period.nth
"""
