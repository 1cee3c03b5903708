"""Changes of the catalogue as DataFrame to DataFrame functions: domains, knowledge bases, chunks, workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import trim_space
from quarry.schemas import GENERAL, effective_domain, reference_date


def by_id(rows: DataFrame, id_: Column | str | int, key: str = "id") -> DataFrame:
    """The row with an id; the filter reaches the scan."""
    return rows.where(F.col(key) == id_)


def listed(rows: DataFrame, newest_first: bool = False, key: str = "id") -> DataFrame:
    """All rows by ``created_at``: knowledge bases with the newest first, domains with the oldest; ties by id."""
    return rows.orderBy(F.desc("created_at") if newest_first else F.asc("created_at"), key)


def chunks_of(chunks: DataFrame, kb: Column | str | int, key: str = "knowledge_base_id", limit: int | None = None) -> DataFrame:
    """A knowledge base's chunks by index, or the first ``limit`` of them; none for an unknown one."""
    out = chunks.where(F.col(key) == kb).orderBy("index")
    return out if limit is None else out.limit(limit)


def loaded(bases: DataFrame, chunks: DataFrame, key: str = "knowledge_base_id") -> DataFrame:
    """The chunks of the knowledge bases that exist, with the names of these (``base_name``)."""
    return chunks.join(bases.select(F.col("id").alias(key), F.col("name").alias("base_name")), key)


def orphans(rows: DataFrame) -> DataFrame:
    """Rows without a domain."""
    return rows.where(F.col("domain_id").isNull())


def with_flags(bases: DataFrame) -> DataFrame:
    """``bases`` with ``is_updated`` (changed over a second after it was made) and ``is_embedded`` (a model is named)."""
    later = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) > 1_000_000
    return bases.withColumns({"is_updated": F.coalesce(later, F.lit(False)), "is_embedded": F.coalesce(F.col("embedding_model_id") != "", F.lit(False))})


def filled_in(*texts: Column) -> Column:
    """Whether all of these texts hold more than white space, as what is saved must."""
    out = F.lit(True)
    for t in texts:
        out = out & (F.coalesce(trim_space(t), F.lit("")) != "")
    return out


def domain_label(rows: DataFrame, domains: DataFrame, hide_general: bool = True) -> DataFrame:
    """``rows`` with ``domain_label``: the domain's name. In lists (``hide_general``) "General" and unknown ones have none; in pickers unknown ones are "General"."""
    named = rows.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("__n")), "domain_id", "left")
    label = F.when(F.col("__n") != "General", F.col("__n")) if hide_general else F.coalesce("__n", F.lit("General"))
    return named.withColumn("domain_label", label).drop("__n")


def domain_created(domains: DataFrame, id_: str, name: str, now: Column) -> DataFrame:
    """``domains`` with a new one, its name trimmed; nothing for a blank name."""
    new = domains.sparkSession.range(1).where(filled_in(F.lit(name))).select(F.lit(id_).alias("id"), trim_space(F.lit(name)).alias("name"), now.cast("timestamp").alias("created_at"), F.lit(False).alias("is_default"))
    return domains.unionByName(new)


def bases_from_json(rows: DataFrame) -> DataFrame:
    """Knowledge bases from rows of ``KNOWLEDGE_BASE_JSON``: dates count from 2001, a missing ``updatedAt`` is ``createdAt``, missing model and domain are null."""
    return rows.select(
        "id", "name", F.col("documentType").alias("document_type"), reference_date(F.col("createdAt")).alias("created_at"), reference_date(F.coalesce("updatedAt", "createdAt")).alias("updated_at"),
        F.col("chunkCount").alias("chunk_count"), F.col("fileSize").alias("file_size"), F.col("embeddingModelID").alias("embedding_model_id"), F.col("domainID").alias("domain_id"),
    )


def migrated(bases: DataFrame, old_bases: DataFrame, chunks: DataFrame, old_chunks: DataFrame, key: str = "knowledge_base_id") -> tuple[DataFrame, DataFrame]:
    """Old knowledge bases that don't exist yet, with their chunks, put to the others. Doing it again changes nothing; one without chunks comes without."""
    new = missing_by(old_bases, bases, "id")
    return bases.unionByName(new), chunks.unionByName(old_chunks.join(new.select(F.col("id").alias(key)), key, "left_semi"))


def settings_migrated(settings: DataFrame, legacy: DataFrame) -> DataFrame:
    """(key, value): the settings, and legacy ones for keys that are absent."""
    return settings.unionByName(legacy.join(settings.select("key"), "key", "left_anti"))


def reimported(bases: DataFrame, chunks: DataFrame, new: DataFrame, now: Column, key: str = "knowledge_base_id") -> tuple[DataFrame, DataFrame]:
    """Knowledge bases that were read again: their chunks give way to the ``new`` ones, ``chunk_count`` and ``updated_at`` follow; ids stay."""
    counts = new.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    out = bases.join(counts, "id", "left").withColumns({"chunk_count": F.coalesce("__n", "chunk_count"), "updated_at": F.when(F.col("__n").isNotNull(), now).otherwise(F.col("updated_at"))})
    return out.drop("__n"), replaced(chunks, new, key)


def reembedded(bases: DataFrame, chunks: DataFrame, model: str, embed, key: str = "knowledge_base_id") -> tuple[DataFrame, DataFrame]:
    """Stale knowledge bases with the vectors of their chunks made anew by ``embed`` (of a content column), and the model's name put down."""
    old = stale(bases, model).select(F.col("id").alias(key), F.lit(True).alias("__s"))
    made = chunks.join(old, key, "left").withColumn("embedding", F.when(F.col("__s"), embed(F.col("content"))).otherwise(F.col("embedding"))).drop("__s")
    is_stale = (F.col("chunk_count") > 0) & ~F.col("embedding_model_id").eqNullSafe(F.lit(model))
    return bases.withColumn("embedding_model_id", F.when(is_stale, F.lit(model)).otherwise(F.col("embedding_model_id"))), made


def of_domain(rows: DataFrame, domain: str, other: bool = False) -> DataFrame:
    """Rows of a domain (null counts as the default one), or of all others."""
    same = effective_domain(F.col("domain_id")) == domain
    return rows.where(~same if other else same)


def ensure_general(domains: DataFrame, now: Column) -> DataFrame:
    """``domains`` with the default domain added if there is none."""
    general = domains.sparkSession.range(1).select(F.lit(GENERAL).alias("id"), F.lit("General").alias("name"), now.cast("timestamp").alias("created_at"), F.lit(True).alias("is_default"))
    return domains.unionByName(general.join(domains.where(F.col("id") == GENERAL).select("id"), "id", "left_anti"))


def adopt_orphans(rows: DataFrame) -> DataFrame:
    """Rows without a domain go to the default one."""
    return rows.withColumn("domain_id", effective_domain(F.col("domain_id")))


def renamed(rows: DataFrame, id_: str, name: str, now: Column | None = None) -> DataFrame:
    """A row's new name, trimmed; a blank name changes nothing. ``updated_at`` moves if ``now`` is given."""
    hit = (F.col("id") == id_) & (trim_space(F.lit(name)) != "")
    out = rows.withColumn("name", F.when(hit, trim_space(F.lit(name))).otherwise(F.col("name")))
    return out if now is None else out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows whose key isn't among those gone: the cascade of a delete."""
    return rows.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def domain_deleted(domains: DataFrame, rows: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Domains without one (the default stays), and rows (domain_id) of it moved to the default one."""
    if id_ == GENERAL:
        return domains, rows
    return domains.where((F.col("id") != id_) | F.col("is_default")), moved(rows, F.col("domain_id") == id_, GENERAL)


def moved(rows: DataFrame, which: Column, domain: str) -> DataFrame:
    """Rows with a new domain where the condition holds."""
    return rows.withColumn("domain_id", F.when(which, F.lit(domain)).otherwise(F.col("domain_id")))


def missing_by(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key doesn't exist: presets by name, migrated rows by id."""
    return new.join(existing.select(key), key, "left_anti")


def chunk_deleted(bases: DataFrame, chunks: DataFrame, chunk_id: str, kb: str = "knowledge_base_id") -> tuple[DataFrame, DataFrame]:
    """Without a chunk; counts are those that are left, indexes stay."""
    left = chunks.where(F.col("id") != chunk_id)
    counts = left.groupBy(F.col(kb).alias("id")).agg(F.count(F.lit(1)).alias("__n"))
    return bases.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n"), left


def replaced(chunks: DataFrame, new: DataFrame, key: str = "knowledge_base_id") -> DataFrame:
    """All chunks of the knowledge bases in ``new`` give way to the new ones."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale(bases: DataFrame, model: str) -> DataFrame:
    """Knowledge bases with chunks whose vectors another model made."""
    return bases.where((F.col("chunk_count") > 0) & ~F.col("embedding_model_id").eqNullSafe(F.lit(model)))


def updated_vectors(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Vectors by id from ``updates`` (id, embedding, and ``seq`` where their order is known): a null clears, an absent id leaves as is; of
    several updates of an id the last one counts, and without an order a vector rather than a null, so no chunk is doubled."""
    order = F.struct(F.col("seq"), F.col("embedding").isNotNull(), "embedding") if "seq" in updates.columns else F.struct(F.col("embedding").isNotNull(), F.col("embedding"))
    new = updates.groupBy("id").agg(F.max_by(F.struct("embedding"), order).alias("__l")).select("id", F.col("__l.embedding").alias("__e"), F.lit(True).alias("__u"))
    return chunks.join(new, "id", "left").withColumn("embedding", F.when(F.col("__u"), F.col("__e")).otherwise(F.col("embedding"))).drop("__e", "__u")


def domain_counts(domains: DataFrame, bases: DataFrame, memories: DataFrame) -> DataFrame:
    """Domains (id, name) with how many knowledge bases and memories each has."""
    count = lambda rows, name: rows.groupBy(effective_domain(F.col("domain_id")).alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = domains.join(count(bases, "n_bases"), "id", "left").join(count(memories, "n_memories"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_bases", "n_memories")})


def grouped_by_domain(domains: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (domain_id, ...) beside their domain (id, name, ...), as ``domain_id`` and ``domain_name``; domains without rows don't occur.

    Groups stay rows, to be sorted or written by domain: as one array, a large domain would have to fit into one task.
    """
    named = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
    return rows.withColumn("domain_id", effective_domain(F.col("domain_id"))).join(named, "domain_id")
