"""Recall: hybrid search with a strategy, a threshold, reasons and associations; each for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.functions.text import memory_id, recall_reason, strategy
from convorecall.functions.times import time_context, window_bounds
from convorecall.operators.search import hybrid_search
from convorecall.schema import DEFAULTS
from convorecall.tables import few


def _request(requests: DataFrame, query_text: Column, kind: Column) -> DataFrame:
    return requests.withColumn("query_text", query_text).withColumn("recall_type", kind)


def recall(memories: DataFrame, index: dict[str, DataFrame], requests: DataFrame, k: int = 5, min_relevance: float = DEFAULTS.min_relevance, as_of: float | None = None, method: str = "pruned") -> DataFrame:
    """Hits of requests (``query_id, query_text, content_vec``, ``recall_type`` and the optional columns of a query).

    A request with only one end of a time range gets 0 as its start or ``as_of`` (epoch seconds, now by default) as its end.
    Returns ``query_id, rank, strategy, memory_key, memory_id, content, relevance_score, recall_reason, timestamp,
    conversation_name, participants``. Fetching more and then cutting by relevance is the same as cutting the ranked
    hits, because relevance is what ranks them.
    """
    if not 1 <= k <= 100 or not 0 <= min_relevance <= 1:
        raise ValueError("k must be from 1 to 100 and min_relevance from 0 to 1")
    end = F.lit(float(as_of)) if as_of is not None else F.unix_timestamp(F.current_timestamp()).cast("double")
    for name in ("t_start", "t_end"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("double"))
    ranged = F.col("t_start").isNotNull() | F.col("t_end").isNotNull()
    requests = requests.withColumns({"t_start": F.when(ranged, F.coalesce("t_start", F.lit(0.0))), "t_end": F.when(ranged, F.coalesce("t_end", end))})
    hits = few(hybrid_search(memories, index, requests, k, method=method).where(F.col("score") >= min_relevance))
    texts = memories.select("memory_key", "content_text", "conversation_name", "participants", "start_timestamp")
    hits = hits.join(texts, "memory_key").join(requests.select("query_id", strategy(F.col("query_text"), F.col("recall_type")).alias("strategy")), "query_id")
    return hits.select(
        "query_id",
        "rank",
        "strategy",
        "memory_key",
        memory_id(F.col("conversation_name"), F.col("start_timestamp")).alias("memory_id"),
        F.col("content_text").alias("content"),
        F.col("score").alias("relevance_score"),
        recall_reason(F.col("bm25_norm"), F.col("vector"), F.col("strategy"), F.col("score")).alias("recall_reason"),
        F.col("start_timestamp").cast("bigint").alias("timestamp"),
        "conversation_name",
        "participants",
    )


def associations(hits: DataFrame) -> DataFrame:
    """Per request: people of its hits, up to five conversations, when they were, and the number of hits."""
    return hits.groupBy("query_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("participants")))).alias("people"),
        F.slice(F.array_sort(F.collect_set("conversation_name")), 1, 5).alias("topics"),
        time_context(F.min("timestamp"), F.max("timestamp")).alias("time_context"),
        F.count("*").alias("total_count"),
    )


def by_topic(memories: DataFrame, index: dict[str, DataFrame], requests: DataFrame, k: int = 10, **more) -> DataFrame:
    """Recall for requests with a ``topic``."""
    return recall(memories, index, _request(requests, F.concat(F.lit("关于"), "topic", F.lit("的讨论")), F.lit("semantic")), k, **more)


def by_people(memories: DataFrame, index: dict[str, DataFrame], requests: DataFrame, k: int = 10, include_mentions: bool = True, **more) -> DataFrame:
    """Recall for requests with a ``person``; without mentions, only hits in which the person took part, after ranking."""
    text = F.concat(F.lit("与"), "person", F.lit("的对话或提到"), "person", F.lit("的讨论"))
    hits = recall(memories, index, _request(requests, text, F.lit("people")), k, **more)
    if include_mentions:
        return hits
    hits = hits.join(requests.select("query_id", "person"), "query_id")
    return hits.where(F.array_contains("participants", F.col("person"))).drop("person")


def by_time(memories: DataFrame, index: dict[str, DataFrame], requests: DataFrame, k: int = 10, **more) -> DataFrame:
    """Recall for requests with ``reference_time`` (epoch seconds), ``direction`` and ``time_window`` (days)."""
    start, end = window_bounds(F.col("reference_time"), F.col("direction"), F.col("time_window"))
    ranged = requests.withColumns({"t_start": start.cast("double"), "t_end": end.cast("double")})
    text = F.concat(F.lit("在 "), F.date_format(F.timestamp_seconds("reference_time"), "yyyy-MM-dd"), F.lit(" 前后的对话"))
    return recall(memories, index, _request(ranged, text, F.lit("temporal")), k, **more)


def simple_search(memories: DataFrame, index: dict[str, DataFrame], queries: DataFrame, k: int = 5, method: str = "pruned") -> DataFrame:
    """Hits without strategy or threshold."""
    kind = queries.withColumn("recall_type", F.lit("semantic"))
    hits = few(hybrid_search(memories, index, kind, k, method=method)).join(memories.select("memory_key", "content_text", "conversation_name", "participants", "start_timestamp"), "memory_key")
    return hits.select("query_id", "rank", "memory_key", memory_id(F.col("conversation_name"), F.col("start_timestamp")).alias("memory_id"), F.col("score").alias("relevance_score"), F.lit("关键词匹配").alias("recall_reason"), F.col("start_timestamp").cast("bigint").alias("timestamp"), "conversation_name", "participants")
