"""Workers (named prompts): presets, switches, invocations, prompts; and what is shared into the engine from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import keywords_of, trim_space
from quarry.operators.catalog import filled_in, missing_by

# What the manager is told if it has workers, and the title of memories that were shared.
MANAGER_NOTE = "\nYou have worker tools. Answer simple questions directly. Delegate specialised tasks to the matching tool."
SHARED_SOURCE = "Shared Content"
# The built-in workers (name, icon, when to use it, instructions).
PRESETS = [
    ("Proofread", "text.badge.checkmark", "Proofread, spell-check, or fix grammar.", "Fix all grammar, spelling, and punctuation errors. Preserve meaning and tone. Return corrected text, then briefly list changes."),
    ("Summarize", "doc.text.magnifyingglass", "Summarize or condense long text.", "Produce a concise summary capturing key points. Use 2-3 sentences or bullet points. Never add information not in the original."),
    ("Rewrite", "pencil.and.outline", "Rewrite or rephrase text for clarity.", "Rewrite the text to be clearer and more polished. Preserve core meaning. Match any tone the user requests."),
    ("Code Reviewer", "terminal", "Review code for bugs or improvements.", "Review the code for bugs, performance, and best practices. Be specific. List critical issues first, then suggestions."),
    ("Translator", "globe", "Translate text between languages.", "Translate accurately, preserving meaning and tone. Provide only the translation unless asked for notes."),
    ("Explain Simply", "lightbulb", "Explain a concept in simple terms.", "Explain in clear, plain language. Use analogies and short sentences. No jargon."),
]


def presets(spark, now: Column) -> DataFrame:
    """The built-in workers as rows of ``WORKER``, enabled."""
    rows = spark.createDataFrame(PRESETS, "name string, icon string, `trigger` string, instructions string")
    return rows.select(F.concat(F.lit("preset-"), F.lower(F.replace("name", F.lit(" "), F.lit("-")))).alias("id"), "name", "icon", "trigger", "instructions", F.lit(True).alias("is_enabled"), F.lit(True).alias("is_built_in"), now.cast("timestamp").alias("created_at"))


def seeded_once(workers: DataFrame, presets: DataFrame) -> DataFrame:
    """``workers`` with all presets if none of them is built in, else as they are."""
    there = workers.where("is_built_in").limit(1).select(F.lit(1).alias("__there"))
    return workers.unionByName(presets.join(there, F.lit(True), "left_anti").select(*workers.columns))


def seeded(workers: DataFrame, presets: DataFrame) -> DataFrame:
    """``workers`` with the presets that are missing by name among the built-in ones."""
    return workers.unionByName(missing_by(presets, workers.where("is_built_in"), "name").select(*workers.columns))


def active(workers: DataFrame) -> DataFrame:
    """Enabled workers by name."""
    return workers.where("is_enabled").orderBy("name")


def library(workers: DataFrame, built_in: bool) -> DataFrame:
    """The built-in workers by name, or one's own with the newest first."""
    rows = workers.where(F.col("is_built_in") == built_in)
    return rows.orderBy("name") if built_in else rows.orderBy(F.desc("created_at"), "id")


def created(workers: DataFrame, id_: str, name: str, trigger: str, instructions: str, now: Column, icon: str = "person.crop.circle") -> DataFrame:
    """``workers`` with a new one, its texts trimmed; as they are if one of them is blank."""
    texts = [F.lit(x) for x in (name, trigger, instructions)]
    new = workers.sparkSession.range(1).where(filled_in(*texts))
    name_, trigger_, instructions_ = map(trim_space, texts)
    new = new.select(F.lit(id_).alias("id"), name_.alias("name"), F.lit(icon).alias("icon"), trigger_.alias("trigger"), instructions_.alias("instructions"), F.lit(True).alias("is_enabled"), F.lit(False).alias("is_built_in"), now.cast("timestamp").alias("created_at"))
    return workers.unionByName(new.select(*workers.columns))


def removed(workers: DataFrame, id_: str | None = None) -> DataFrame:
    """Without a worker, or without all."""
    return workers.where(F.col("id") != id_) if id_ is not None else workers.limit(0)


def recorded(log: DataFrame, invocations: DataFrame) -> DataFrame:
    """The log of invocations (conversation, seq, worker) with more of them."""
    return log.unionByName(invocations.select(*log.columns))


def drained(log: DataFrame, upto: Column) -> tuple[DataFrame, DataFrame]:
    """The invocations up to a place of the log, in order, and the log without them."""
    return log.where(F.col("seq") <= upto).orderBy("seq"), log.where(F.col("seq") > upto)


def toggled(workers: DataFrame, id_: str) -> DataFrame:
    return workers.withColumn("is_enabled", F.when(F.col("id") == id_, ~F.col("is_enabled")).otherwise(F.col("is_enabled")))


def saved(workers: DataFrame, id_: str, name: str, trigger: str, instructions: str) -> DataFrame:
    """A worker's new texts, trimmed; nothing changes if one of them is blank."""
    texts = {"name": name, "trigger": trigger, "instructions": instructions}
    full = F.lit(all(x.strip() for x in texts.values()))
    return workers.withColumns({k: F.when(full & (F.col("id") == id_), trim_space(F.lit(v))).otherwise(F.col(k)) for k, v in texts.items()})


def usage_summaries(invocations: DataFrame, key: str, worker: str) -> DataFrame:
    """(key, summary): "Used X", "Used X (3x)", or all names, sorted."""
    counts = invocations.groupBy(key, worker).agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.array_sort(F.collect_list(worker)).alias("names"))
    once = F.concat(F.lit("Used "), F.col("names")[0], F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))).otherwise(""))
    return by.select(key, F.when(F.col("kinds") == 1, once).otherwise(F.concat(F.lit("Used "), F.array_join("names", ", "))).alias("summary"))


def manager_prompt(instructions: Column, n_workers: Column, summary: Column) -> Column:
    """Instructions, a note if there are workers, and the summary of what went before."""
    context = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\nContext: "), summary)).otherwise("")
    return F.concat(instructions, F.when(n_workers > 0, F.lit(MANAGER_NOTE)).otherwise(""), context)


def effective_instructions(own: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), default)


def shared_memories(shared: DataFrame) -> DataFrame:
    """(id, content, keywords, source_title) of shared texts (id, text, action) that are to be remembered."""
    rows = shared.where("action = 'saveAsMemory'").select("id", F.col("text").alias("content"))
    return rows.withColumns({"keywords": keywords_of(F.col("content"), 5), "source_title": F.lit(SHARED_SOURCE)})


def shared_messages(shared: DataFrame) -> DataFrame:
    """(id, role, content) of shared texts that begin a conversation."""
    return shared.where("action = 'startConversation'").select("id", F.lit("user").alias("role"), F.col("text").alias("content"))


def intake(items: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text) of what came in together: texts and addresses in order, with a blank line between. Of an attachment that has both (rows of
    kinds ``text`` and ``url`` at one place) the text counts. What is empty as a whole gives no row."""
    one = items.where(F.col("kind").isin("text", "url")).groupBy(key, order).agg(F.min_by("value", "kind").alias("__v"))  # text comes before url
    parts = one.where(F.col("__v").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__v").alias("v")))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda x: x["v"]), "\n\n").alias("text")).where("text <> ''")
