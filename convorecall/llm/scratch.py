"""Intermediate tables, sides of joins that are small, and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convorecall.tables import SMALL_ROWS, removed, scope, shared_dir, written

__all__ = ["drawn", "removed", "scope", "shared_dir", "small", "texts_of", "written"]


def small(ids: DataFrame) -> DataFrame:
    """``ids``, a written table of a few bigint columns, with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


def drawn(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of ``df``, in the order of a hash of their ``doc_id``.

    Where there are many more, a bound on the hash first leaves about one and a half times ``n``, so that what the tasks
    send together does not grow with the table.
    """
    order, limit = F.xxhash64("doc_id", F.lit(seed)), 1 << 30
    total = df.count()
    if total > 2 * n:
        df = df.where(F.pmod(order, F.lit(limit)) < int(limit * 1.5 * n / total) + 1)
    return df.orderBy(F.pmod(order, F.lit(limit)), order, "doc_id").limit(n)


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """``text`` of the few ``picked`` ids, with their other columns, in the order of the ids."""
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null").orderBy("doc_id")
