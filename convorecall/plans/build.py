"""Building a store: messages to sessions, to texts, to vectors, to Parquet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convorecall.operators.embed import embed, hashed_embedding
from convorecall.operators.search import build_index
from convorecall.operators.sessions import enriched, sessions
from convorecall.sources import store


def memories_of(messages: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 256, **limits) -> DataFrame:
    """Memories of messages; without an embedder their vectors are hashed term counts."""
    df = enriched(sessions(messages, **limits)).drop("messages")
    if embedder is not None:
        df = embed(df, embedder, dim, "conversation_key", ["session_type", "batch"])
    else:
        df = hashed_embedding(hashed_embedding(df, "content_text", "content_embedding", dim), "context_text", "context_embedding", dim)
    start, end = (F.unix_timestamp(c).cast("double") for c in ("start_ts", "end_ts"))
    df = df.withColumns({"start_timestamp": start, "end_timestamp": end, "year": F.year("start_ts"), "month": F.month("start_ts")})
    return df.withColumn("memory_key", F.xxhash64("conversation_key", "session_type", "batch"))


def build(messages: DataFrame, path: str, embedder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 256, **limits) -> None:
    """Write the store and its text index under ``path``."""
    store.save(memories_of(messages, embedder, dim, **limits), f"{path}/memories")
    store.save_index(build_index(store.load(messages.sparkSession, f"{path}/memories")), f"{path}/index")
