"""Knowledge bases and their chunks as stored tables that change as a whole.

Both tables are dealt into buckets by a hash of the knowledge base's id. A change writes the buckets that it touches anew, into folders of its own,
chunks first; then one entry of the log (``storage.Generations``) makes both tables' new buckets count at once. A run that dies at any point
before leaves the old tables, and can be run again; one that has counted already, known by its name, does nothing. So no reader ever sees
chunks without their knowledge base, or a knowledge base that was read again with its old chunks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quarry.storage import Generations


@dataclass(frozen=True)
class CatalogStore:
    """``bases`` (id, ...) and ``chunks`` (key, ...) below ``path``; a change rewrites whole buckets, so ``buckets`` grows with the tables."""

    spark: SparkSession
    path: str
    buckets: int = 16
    key: str = "knowledge_base_id"

    @property
    def log(self) -> Generations:
        return Generations(self.spark, self.path)

    def _bucket(self, id_: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_)), F.lit(self.buckets)).cast("int")

    def _parts(self) -> dict[int, str]:
        """The folder of each bucket that has been written."""
        return {int(p.split(":")[1]): p.split(":")[2] for p in self.log.parts() if p.startswith("bucket:")}

    def _schema(self, table: str) -> StructType | None:
        found = [p.split(":", 2)[2] for p in self.log.parts() if p.startswith(f"schema:{table}:")]
        return StructType.fromJson(json.loads(found[0])) if found else None

    def _read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets or of all; a folder that holds several is pruned by bucket."""
        schema = self._schema(table)
        if schema is None:
            raise ValueError(f"no {table} at {self.path}")
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in self._parts().items():
            if only is None or bucket in only:
                by_folder.setdefault(folder, []).append(bucket)
        out = self.spark.createDataFrame([], schema)
        for folder, buckets in by_folder.items():
            out = out.union(self.spark.read.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(f"{self.path}/{table}/{folder}").where(F.col("bucket").isin(buckets)).drop("bucket"))
        return out

    def bases(self) -> DataFrame:
        return self._read("bases")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def changed(self, bases: DataFrame | None = None, chunks: DataFrame | None = None, deleted: DataFrame | None = None, change: str | None = None) -> CatalogStore:
        """Put knowledge bases in with all their chunks, new ones or in place of those with their ids, and take out those in ``deleted`` (id) with theirs.

        Chunks of other knowledge bases than those put in are left out. A null id is a knowledge base of its own kind and stays with its chunks.
        """
        log = self.log
        if log.knows(change) or (bases is None and deleted is None):
            return self
        after, before = log.last(), self._parts()
        ids = None
        for rows in (bases, deleted):
            if rows is not None:
                ids = rows.select("id") if ids is None else ids.union(rows.select("id"))
        ids = ids.distinct()
        touched = sorted(r["b"] for r in ids.select(self._bucket("id").alias("b")).distinct().collect())  # at most ``buckets`` numbers
        folder = log.new_part()

        schemas = {}

        def write(table: str, key: str, new: DataFrame | None) -> None:
            gone = ids.select(F.col("id").alias("__id"))
            if new is not None:
                new = new.join(bases.select(F.col("id").alias("__id")).distinct(), F.col(f"`{key}`").eqNullSafe(F.col("__id")), "left_semi")
            if self._schema(table) is None:
                rows = new
            else:
                rows = self._read(table, touched).join(gone, F.col(f"`{key}`").eqNullSafe(F.col("__id")), "left_anti")
                rows = rows.unionByName(new, allowMissingColumns=True) if new is not None else rows
            if rows is None:
                raise ValueError(f"the first change brings {table}")
            schemas[table] = rows.schema
            rows.withColumn("bucket", self._bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{folder}")

        write("chunks", self.key, chunks)
        write("bases", "id", bases)
        counted = before | {b: folder for b in touched}
        named = [f"schema:{table}:{schema.json()}" for table, schema in schemas.items()]
        log.commit([*named, *(f"bucket:{b}:{f}" for b, f in sorted(counted.items()))], change, after)
        return self
