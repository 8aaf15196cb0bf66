"""Curation: profiles of conversations, lists of those of little value, and the corpus without them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.functions.times import days_since


def profile(messages: DataFrame, as_of: Column, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation: messages, text messages, first and last time by order in the file, days since the last.

    With ``conversations`` (``conversation_key, conversation_name, conversation_type``) those without messages are there too.
    """
    keys = ["conversation_key", "conversation_name", "conversation_type"]
    found = messages.groupBy(*keys).agg(
        F.count("*").alias("message_count"),
        F.count_if(F.col("msg_type") == 0).alias("text_message_count"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.array_sort(F.collect_set("sender_name")).alias("members"),
    )
    if conversations is not None:
        found = conversations.select(*keys).join(found.drop("conversation_name", "conversation_type"), "conversation_key", "left").na.fill(0, ["message_count", "text_message_count"])
    return found.withColumn("days_since_last", days_since(F.col("last_ts"), as_of))


def type_counts(profiles: DataFrame) -> DataFrame:
    """Conversations of each type; all but groups and private ones are other."""
    kind = F.when(F.col("conversation_type").isin("group", "private"), F.col("conversation_type")).otherwise("other")
    return profiles.groupBy(kind.alias("conversation_type")).agg(F.count("*").alias("n"))


def inactive_groups(profiles: DataFrame, days: int = 10) -> DataFrame:
    """Groups without a message for more than ``days`` days, the longest silent first."""
    return profiles.where(f"conversation_type = 'group' and days_since_last > {days}").orderBy(F.desc("days_since_last"), "conversation_key")


def quiet_private(profiles: DataFrame, messages: int = 20) -> DataFrame:
    """Private conversations of fewer than ``messages`` text messages, the shortest first."""
    return profiles.where(f"conversation_type = 'private' and text_message_count < {messages}").orderBy("text_message_count", "conversation_key")


def old_private(profiles: DataFrame, days: int = 365) -> DataFrame:
    """Private conversations without a message for more than ``days`` days, the longest silent first."""
    return profiles.where(f"conversation_type = 'private' and days_since_last > {days}").orderBy(F.desc("days_since_last"), "conversation_key")


def removals(profiles: DataFrame, days: int = 10, messages: int = 20) -> DataFrame:
    """Inactive groups and quiet private conversations with the ``reason``."""
    return inactive_groups(profiles, days).withColumn("reason", F.lit("inactive")).unionByName(quiet_private(profiles, messages).withColumn("reason", F.lit("quiet")))


def keep_list(profiles: DataFrame, removed: DataFrame) -> DataFrame:
    """Conversations in no list of removals, those with most messages first."""
    return profiles.join(removed.select("conversation_key"), "conversation_key", "left_anti").orderBy(F.desc("message_count"), "conversation_key")


def summary(profiles: DataFrame, removed: DataFrame) -> DataFrame:
    """Conversations and messages to remove, in numbers and percent; 0 percent of nothing."""
    marked = profiles.join(removed.select("conversation_key", F.lit(1).alias("gone")).distinct(), "conversation_key", "left")
    gone = F.coalesce(F.col("gone"), F.lit(0))
    sums = marked.agg(F.count("*").alias("conversations"), F.sum(gone).alias("removed"), F.sum("message_count").alias("messages"), F.sum(gone * F.col("message_count")).alias("removed_messages"))
    percent = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return sums.na.fill(0).select("*", percent("removed", "conversations").alias("removed_percent"), percent("removed_messages", "messages").alias("removed_messages_percent"))


def head(listed: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first rows of a list, and how many more there are."""
    return listed.limit(n), listed.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def purge(messages: DataFrame, removed: DataFrame) -> DataFrame:
    """Messages of the conversations that stay; to be written to a new place."""
    return messages.join(removed.select("conversation_key").distinct(), "conversation_key", "left_anti")


def as_of(year: int, month: int, day: int) -> Column:
    """A day as the time that ages are counted to."""
    return F.lit(datetime.datetime(year, month, day))
