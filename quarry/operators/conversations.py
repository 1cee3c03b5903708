"""Conversation logs: search, buckets by date, separators, the last messages, transcripts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import auto_title, fact_lines, trim_space
from quarry.schemas import CONVERSATION


def date_bucket(created: Column, now: Column) -> Column:
    """Today, Yesterday, This Week (after now less 7 days), This Month (after now less a month), Older. Days are those of the session's zone."""
    day = F.to_date(now)
    return (
        F.when(F.to_date(created) == day, "Today")
        .when(F.to_date(created) == F.date_sub(day, 1), "Yesterday")
        .when(created > now - F.expr("interval 7 days"), "This Week")
        .when(created > now - F.expr("interval 1 month"), "This Month")
        .otherwise("Older")
    )


def bucket_rank(bucket: Column) -> Column:
    """The order in which buckets are shown."""
    return F.array_position(F.array(*(F.lit(x) for x in ("Today", "Yesterday", "This Week", "This Month", "Older"))), bucket)


def date_separators(rows: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """``rows`` with ``separator``: the first of a conversation, or on another day than the one before."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("separator", before.isNull() | (F.to_date(before) != F.to_date(ts)))


def last_of_role(messages: DataFrame, key: str, order: str, role: str = "assistant") -> DataFrame:
    """``messages`` with ``is_last``: the last message of the role in its conversation."""
    last = F.max(F.when(F.col("role") == role, F.col(order))).over(W.partitionBy(key))
    return messages.withColumn("is_last", F.coalesce(F.col(order) == last, F.lit(False)))


def regenerate_pair(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, assistant, user): the last assistant message's place and that of the last user message before it."""
    before = F.max(F.when(F.col("role") == "user", F.col(order))).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    last = F.when(F.col("role") == "assistant", F.struct(F.col(order).alias("a"), before.alias("u")))
    best = messages.select(key, last.alias("__p")).groupBy(key).agg(F.max("__p").alias("__p"))
    return best.select(key, F.col("__p.a").alias("assistant"), F.col("__p.u").alias("user"))


def tail(messages: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last ``n`` messages of each conversation."""
    return messages.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def truncated(messages: DataFrame, targets: DataFrame, key: str, order: str) -> DataFrame:
    """Messages before each conversation's target place (key, target); conversations without a target stay whole."""
    return messages.join(targets, key, "left").where(F.col("target").isNull() | (F.col(order) < F.col("target"))).drop("target")


def transcripts(messages: DataFrame, key: str, order: str, content: str, n: int = 6) -> DataFrame:
    """(key, transcript) of the last ``n`` messages; every role but the user's speaks as the assistant."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col(content))
    ordered = tail(messages, key, order, n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("__l"))
    return ordered.select(key, F.array_join(F.transform("__l", lambda x: x["l"]), "\n").alias("transcript"))


def search(messages: DataFrame, titles: DataFrame, query: str, key: str, content: str) -> DataFrame:
    """Keys of conversations (titles: key, title) whose title or any message holds the query, whatever the case; all for an empty one."""
    if not query:
        return titles.select(key)
    has = lambda c: F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return titles.where(has("title")).select(key).union(messages.where(has(content)).select(key)).distinct()


def titles(messages: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, title) from the first user message of each conversation."""
    first = messages.where(F.col("role") == "user").groupBy(key).agg(F.min_by(content, order).alias("__t"))
    return first.select(key, auto_title(F.col("__t")).alias("title"))


def exported(messages: DataFrame, heads: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, text): a conversation as plain text. ``heads``: key, title, created_at, prompt; a ``ts`` column in messages is optional."""
    time = F.date_format("ts", "HH:mm") if "ts" in messages.columns else F.lit("")
    label = F.when(F.col("role") == "user", "You").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    body = F.concat(F.lit("["), time, F.lit("] "), label, F.lit(":\n"), F.col(content), F.lit("\n"))
    lines = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))).alias("__l"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("Date: "), F.date_format("created_at", "yyyy-MM-dd HH:mm")), F.when(F.coalesce("prompt", F.lit("")) != "", F.concat(F.lit("System: "), F.col("prompt"))), F.lit(""))
    return heads.join(lines, key, "left").select(key, F.concat(head, F.lit("\n"), F.coalesce(F.array_join(F.transform("__l", lambda x: x["b"]), "\n"), F.lit(""))).alias("text"))


def restored_turns(messages: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, turns): half of the messages that aren't the system's, ``most`` at most."""
    return messages.groupBy(key).agg(F.least(F.floor(F.count_if(F.col("role") != "system") / 2), F.lit(most)).cast("long").alias("turns"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations from JSON files that each hold one list of them; a file that can't be read gives none. Missing fields are null."""
    return spark.read.schema(CONVERSATION).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def messages_of(conversations: DataFrame) -> DataFrame:
    """(conversation_id, pos, id, role, content, timestamp): the messages of conversations as rows."""
    return conversations.select(F.col("id").alias("conversation_id"), F.posexplode("messages").alias("pos", "m")).select("conversation_id", "pos", "m.*")


def snapshots(heads: DataFrame, messages: DataFrame, key: str, order: str) -> DataFrame:
    """``heads`` (key, ...) with ``messages``: the rows of each conversation in order, as one value, as they are stored."""
    rest = [c for c in messages.columns if c not in (key, order)]
    held = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("messages"))
    return heads.join(held, key, "left")


def created(heads: DataFrame, id_: str, now: Column, prompt: str | None = None, domain: str | None = None) -> DataFrame:
    """``heads`` (id, title, created_at, custom_system_prompt, domain_id) with a new conversation."""
    new = heads.sparkSession.range(1).select(F.lit(id_).alias("id"), F.lit("New Chat").alias("title"), now.cast("timestamp").alias("created_at"), F.lit(prompt).cast("string").alias("custom_system_prompt"), F.lit(domain).cast("string").alias("domain_id"))
    return heads.unionByName(new, allowMissingColumns=True)


def deleted(heads: DataFrame, messages: DataFrame, which: Column, key: str = "id", message_key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Conversations for which the condition doesn't hold, and their messages."""
    gone = heads.where(which).select(F.col(key).alias(message_key))
    return heads.where(~which), messages.join(gone, message_key, "left_anti")


def retitled(heads: DataFrame, id_: Column | str | int, title: str, key: str = "id") -> DataFrame:
    """A conversation's new title, trimmed; a blank one changes nothing."""
    hit = (F.col(key) == id_) & (trim_space(F.lit(title)) != "")
    return heads.withColumn("title", F.when(hit, trim_space(F.lit(title))).otherwise(F.col("title")))


def restarted(heads: DataFrame, messages: DataFrame, id_: Column | str | int, key: str = "id", message_key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """A conversation begun anew: no messages, no turns, the first title."""
    hit = F.col(key) == id_
    fresh = {"title": F.when(hit, "New Chat").otherwise(F.col("title"))} | ({"turns": F.when(hit, 0).otherwise(F.col("turns"))} if "turns" in heads.columns else {})
    return heads.withColumns(fresh), messages.where(F.col(message_key) != id_)


def prompted(heads: DataFrame, id_: Column | str | int, prompt: str | None, key: str = "id") -> DataFrame:
    """A conversation's new prompt (null: the default one); its turns count from 0 again."""
    hit = F.col(key) == id_
    return heads.withColumns({"custom_system_prompt": F.when(hit, F.lit(prompt)).otherwise(F.col("custom_system_prompt")), "turns": F.when(hit, 0).otherwise(F.col("turns"))})


def message_deleted(messages: DataFrame, which: Column) -> DataFrame:
    return messages.where(~which)


def most_turns(has_workers: Column, turns: int = 6) -> Column:
    """Turns until a conversation's context is rotated: one less with workers, but three at least."""
    return F.when(has_workers, max(turns - 1, 3)).otherwise(turns)


# Fixed value: the message that a rotation leaves.
REFRESHED = "Context refreshed — I still remember the key points."


def rotated(messages: DataFrame, turns: DataFrame, key: str, order: str, content: str, summarise=None, recent: int = 6, extract=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rotate the context of the conversations whose ``turns`` (key, turns, has_workers, summary) have reached their most.

    Gives their transcripts of the ``recent`` last messages with the summary that the caller's function makes of them (null or no function:
    the old one); the facts in the lines of what the caller's function ``extract`` answers to the transcripts (null or no function: none), for
    the memory log; and the state after it (key, turns, summary). A transcript's own lines are no facts.
    """
    due = turns.where(F.col("turns") >= most_turns(F.col("has_workers")))
    text = transcripts(messages.join(due.select(key), key, "left_semi"), key, order, content, recent)
    made = F.coalesce(summarise(F.col("transcript")), F.col("summary"), F.lit("")) if summarise else F.coalesce("summary", F.lit(""))
    done = text.join(due.select(key, "summary"), key).select(key, "transcript", made.alias("summary"), F.lit(REFRESHED).alias("note"))
    answers = text.select(key, (extract(F.col("transcript")) if extract else F.lit(None)).cast("string").alias("answer"))
    facts = fact_lines(answers, key, "answer")
    after = turns.withColumnRenamed("summary", "__old").join(done.select(key, F.col("summary").alias("__new")), key, "left")
    after = after.select(key, F.when(F.col("__new").isNotNull(), 0).otherwise(F.col("turns")).alias("turns"), F.coalesce("__new", "__old").alias("summary"))
    return done, facts, after
