"""Evaluation of fusion weights: query generation, one scoring fused under many weights, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convorecall.functions.text import bigrams, is_query_word, judged, relevance_or_score, tokens
from convorecall.operators.search import components
from convorecall.schema import WEIGHTS
from convorecall.tables import few


def frequent_words(messages: DataFrame, first: int = 50, k: int = 10) -> DataFrame:
    """``conversation_key, text, n``: the most frequent words; stop words are left out of the ``first``, then k stay."""
    words = messages.where(F.length("content") >= 2).select("conversation_key", F.explode(tokens(F.col("content"))).alias("text")).where(F.length("text") > 1)
    return _most(words, first, is_query_word(F.col("text")), k)


def frequent_pairs(messages: DataFrame, first: int = 30, k: int = 10) -> DataFrame:
    """``conversation_key, text, n``: the most frequent pairs of characters that occur twice or more."""
    pairs = messages.where(F.length("content") >= 2).select("conversation_key", F.explode(bigrams(F.col("content"))).alias("text"))
    return _most(pairs, first, F.col("n") >= 2, k)


def _most(items: DataFrame, first: int, keep, k: int) -> DataFrame:
    counted = items.groupBy("conversation_key", "text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("conversation_key").orderBy(F.desc("n"), "text")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).where(keep)
    return top.withColumn("r", F.row_number().over(Window.partitionBy("conversation_key").orderBy("r"))).where(F.col("r") <= k).drop("r")


def sample_sentences(messages: DataFrame, seed: int = 1, k: int = 5, chars: int = 30) -> DataFrame:
    """``conversation_key, text``: beginnings of a few messages of over ten characters, drawn by a hash of the seed and the place."""
    place = F.md5(F.concat_ws("_", F.lit(str(seed)), "conversation_key", F.col("seq").cast("string")))
    order = Window.partitionBy("conversation_key").orderBy(place, "seq")
    drawn = messages.where(F.length("content") > 10).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return drawn.select("conversation_key", F.substring("content", 1, chars).alias("text"))


def generated_queries(messages: DataFrame, seed: int = 1) -> DataFrame:
    """``conversation_key, type, text``: keywords, pairs of characters as semantic queries, sentences as mixed ones."""
    kinds = (("keyword", frequent_words(messages)), ("semantic", frequent_pairs(messages)), ("mixed", sample_sentences(messages, seed)))
    first, *rest = [df.select("conversation_key", F.lit(name).alias("type"), "text") for name, df in kinds]
    for df in rest:
        first = first.unionByName(df)
    return first


def first_of_each_type(queries: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queries of each type and conversation, by their text."""
    order = Window.partitionBy("conversation_key", "type").orderBy("text")
    return queries.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def weight_table(spark: SparkSession, weights: list[float] | None = None) -> DataFrame:
    """Candidate weights; the two of a pair sum to 1."""
    return spark.createDataFrame([(float(w), 1.0 - float(w)) for w in weights or WEIGHTS], "bm25_weight double, vector_weight double")


def weight_grid(memories: DataFrame, index: dict[str, DataFrame], queries: DataFrame, weights: DataFrame, k: int = 5, method: str = "pruned") -> DataFrame:
    """Hits of every query under every weight: scored once, then fused per weight."""
    parts = components(memories, index, queries, k, method=method)
    every = parts.crossJoin(F.broadcast(weights))  # a handful of weights
    score = F.col("bm25_weight") * F.col("bm25_norm") + F.col("vector_weight") * F.col("vector")
    order = Window.partitionBy("query_id", "bm25_weight").orderBy(F.desc("score"), "memory_key")
    ranked = every.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "bm25_weight", "vector_weight", "rank", "memory_key", "score", "bm25_norm", "vector")


def labelled_results(hits: DataFrame, labelled: DataFrame, memories: DataFrame, k: int = 3, chars: int = 500) -> DataFrame:
    """The result table of a labelled query set: hits of a weight grid with the query's ``type`` and ``expected``, and the memory.

    Returns the hits' columns up to rank ``k``, ``type, expected, content`` (the first ``chars`` characters), ``timestamp`` and
    ``matched``, the share of the expected keywords (or synonyms) that the memory's whole text holds.
    """
    found = few(hits.where(F.col("rank") <= k))
    found = found.join(memories.select("memory_key", "content_text", F.col("start_timestamp").cast("bigint").alias("timestamp")), "memory_key").join(labelled.select("query_id", "type", "expected"), "query_id")
    held = F.transform(F.array(F.lower("content_text")), lambda low: F.size(F.filter("expected", lambda w: F.contains(low, F.lower(w)))))[0]  # a text is lowered once, not once a word
    matched = F.coalesce(F.try_divide(held, F.size("expected")), F.lit(0.0))
    return found.withColumns({"content": F.substring("content_text", 1, chars), "matched": matched}).drop("content_text")


def labelled_metrics(results: DataFrame) -> DataFrame:
    """Per weight and type of query: queries, mean share of keywords in first hits and in all, mean score of first hits."""
    first = F.col("rank") == 1
    return results.groupBy("bm25_weight", "type").agg(
        F.countDistinct("query_id").alias("n_queries"),
        F.avg(F.when(first, F.col("matched"))).alias("matched_top1"),
        F.avg("matched").alias("matched_all"),
        F.avg(F.when(first, F.col("score"))).alias("score_top1"),
    )


def with_relevance(hits: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Hits with ``relevance``: the judge's score of ``replies`` (``query_id`` and ``memory_key`` or the latter, ``reply``), or without a judge ten times the hit's score."""
    if replies is None:
        return hits.withColumn("relevance", relevance_or_score(F.lit(None).cast("double"), F.col("score")))
    keys = [c for c in ("query_id", "memory_key") if c in replies.columns]
    return hits.join(replies.select(*keys, "reply"), keys, "left").withColumn("relevance", judged(F.col("reply")))


def separation(hits: DataFrame) -> DataFrame:
    """Per weight: how far the first hit's score is above the third's (0 if there is none)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    per_query = hits.groupBy("bm25_weight", "query_id").agg((at(1) - F.coalesce(at(3), F.lit(0.0))).alias("diff"))
    return per_query.groupBy("bm25_weight").agg(F.avg("diff").alias("avg_diff"), F.min("diff").alias("min_diff"), F.max("diff").alias("max_diff"), F.count("*").alias("n_queries"))


def relevance(hits: DataFrame, top: int = 3) -> DataFrame:
    """Per weight over hits with ``relevance``: mean of all, of first hits, and of the queries' means over the top three."""
    per_query = hits.where(F.col("rank") <= top).groupBy("bm25_weight", "query_id").agg(F.sum("relevance").alias("total"), F.count("relevance").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("relevance"))).alias("first"))
    return per_query.groupBy("bm25_weight").agg((F.sum("total") / F.sum("n")).alias("avg_all"), F.avg("first").alias("avg_top1"), F.avg(F.col("total") / F.col("n")).alias("avg_top3"), F.sum("n").alias("n"))


def best_weight(metrics: DataFrame, metric: str) -> DataFrame:
    """The weight with the best mean of ``metric`` over conversations; of equals the smallest."""
    means = metrics.groupBy("bm25_weight").agg(F.avg(metric).alias(metric))
    return means.orderBy(F.desc(metric), "bm25_weight").limit(1)


def keyword_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Over queries with ``expected`` keywords: share with a hit, mean relevance, and mean share of keywords in the first hit.

    ``hits`` has ``query_id, rank, score, content``. A query without a hit counts as 0.
    """
    first = hits.where("rank = 1").select("query_id", "score", F.lower("content").alias("content"))
    found = queries.select("query_id", "expected").join(first, "query_id", "left")
    matched = F.size(F.filter("expected", lambda w: F.contains(F.col("content"), F.lower(w)))) / F.size("expected")
    return found.agg(F.avg(F.col("score").isNotNull().cast("int")).alias("found_rate"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_relevance"), F.avg(F.coalesce(F.when(F.col("score").isNotNull(), matched), F.lit(0.0))).alias("mean_match"), F.count("*").alias("n_queries"))


def composite(scores: DataFrame) -> DataFrame:
    """Mean per weight over query sets, each counting with its queries: of ``bm25_weight, total, n``."""
    return scores.groupBy("bm25_weight").agg((F.sum("total") / F.sum("n")).alias("composite"))


def top1_table(hits: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Each query's first hit under each weight, side by side."""
    return hits.where("rank = 1").groupBy("query_id").pivot("bm25_weight", weights or WEIGHTS).agg(F.first("memory_key"))
