"""Batches of texts for an embedder, and the job that embeds both texts of each session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convorecall.functions.text import token_estimate
from convorecall.schema import DEFAULTS

#: Rows whose requests are sent before their vectors leave the task.
ANSWERED = 1000


def token_batches(df: DataFrame, group: str, order: str, text: str | list[str], limit: int = DEFAULTS.batch_tokens) -> DataFrame:
    """``group, order, tokens, batch``: batches in order, each of at most ``limit`` estimated tokens or of one row.

    A row's tokens are those of all its ``text`` columns together, as a session's content and context go by one request.
    Rows are followed in order, one group after another, so a task holds a group's running total and nothing more.
    """
    texts = [text] if isinstance(text, str) else text
    tokens = reduce(Column.__add__, [F.coalesce(token_estimate(F.col(t)), F.lit(0)) for t in texts])
    rows = df.select(group, order, tokens.alias("tokens")).repartition(group).sortWithinPartitions(group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, number = None, 0, -1
        for batch in batches:
            out = np.empty(batch.num_rows, np.int32)
            for i, (g, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if number < 0 or g != key:
                    key, total, number = g, n, 0
                elif total + n > limit:
                    total, number = n, number + 1
                else:
                    total += n
                out[i] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "batch"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([*kinds, "batch int"]))


def fixed_batches(df: DataFrame, group: str, order: str, size: int = DEFAULTS.batch_texts) -> DataFrame:
    """``df`` with batches of ``size`` rows."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size))


def batch_stats(batched: DataFrame, group: str) -> DataFrame:
    """Number of batches, and least, most and mean rows of one."""
    sizes = batched.groupBy(group, "batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("batches"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def _requests(embedder: Callable[[list[str]], np.ndarray], dim: int, group: str | None, limit: int, texts: int, errors: tuple[type[Exception], ...]):
    """Rows in order to the same with both vectors; those of many requests leave together."""

    def asked(column: pa.Array) -> np.ndarray:
        try:
            return np.asarray(embedder(column.to_pylist()), dtype=np.float32).reshape(len(column), dim)
        except errors:
            return np.zeros((len(column), dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, count = None, 0, 0
        held: list[pa.RecordBatch] = []  # rows of the request that has not ended

        def answered(rows: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
            """``rows`` with the vectors of their requests, which end at ``ends``."""
            vectors = []
            for text in ("content_text", "context_text"):
                column = rows.column(text).fill_null("")
                parts = [asked(column.slice(lo, hi - lo)) for lo, hi in zip([0, *ends], ends)]
                offsets = np.arange(0, rows.num_rows * dim + 1, dim, dtype=np.int32) if dim else np.zeros(rows.num_rows + 1, np.int32)
                vectors.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).ravel())))
            return pa.RecordBatch.from_arrays([*rows.columns, *vectors], names=[*rows.schema.names, "content_embedding", "context_embedding"])

        for whole in batches:
            for batch in (whole.slice(lo, ANSWERED) for lo in range(0, whole.num_rows, ANSWERED)):
                sizes = sum(np.floor(pc.utf8_length(batch.column(c).fill_null("")).to_numpy(zero_copy_only=False) * 1.5).astype(np.int64) for c in ("content_text", "context_text")).tolist()
                groups = batch.column(group).to_pylist() if group else [None] * len(sizes)
                before, ends = sum(b.num_rows for b in held), []
                for i, (g, n) in enumerate(zip(groups, sizes)):
                    if count and (g != key or total + n > limit or count >= texts):
                        ends.append(before + i)
                        total, count = 0, 0
                    key, total, count = g, total + n, count + 1
                held.append(batch)
                if ends:
                    rows = pa.concat_batches(held)
                    held = [rows.slice(ends[-1])]
                    yield answered(rows.slice(0, ends[-1]), ends)
        if held:
            rows = pa.concat_batches(held)
            yield answered(rows, [rows.num_rows])

    return run


def embed(
    sessions: DataFrame,
    embedder: Callable[[list[str]], np.ndarray],
    dim: int,
    group: str | None = None,
    order: list[str] | None = None,
    limit: int = DEFAULTS.batch_tokens,
    texts: int = DEFAULTS.batch_texts,
    errors: tuple[type[Exception], ...] = (OSError, RuntimeError),
) -> DataFrame:
    """Add ``content_embedding`` and ``context_embedding`` by an embedder from texts to a matrix.

    Requests follow the sessions of one ``group`` in ``order`` and end where `token_batches` over both texts would end a
    batch, or at ``texts`` sessions; both texts of a request's sessions are sent. A request that fails with one of ``errors``
    gives zero vectors, which `run_summary` counts; any other error ends the job.
    """

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sessions.schema.fields)
    if group:
        sessions = sessions.repartition(group).sortWithinPartitions(group, *(order or []))
    return sessions.mapInArrow(_requests(embedder, dim, group, limit, texts, errors), f"{fields}, content_embedding array<float>, context_embedding array<float>")


def hashed_embedding(df: DataFrame, text: str, out: str, dim: int = 256) -> DataFrame:
    """Offline embedding on the JVM: hashed term counts of unit length."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from convorecall.functions.text import tokens

    df = HashingTF(numFeatures=dim, inputCol="_terms", outputCol="_tf").transform(df.withColumn("_terms", tokens(F.col(text))))
    df = Normalizer(inputCol="_tf", outputCol="_unit").transform(df)
    return df.withColumn(out, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_unit")


def run_summary(embedded: DataFrame) -> DataFrame:
    """Sessions embedded, and those whose content vector is zero."""
    zero = F.forall("content_embedding", lambda x: x == 0)
    return embedded.agg(F.count("*").alias("total"), F.count_if(~zero).alias("success"), F.count_if(zero).alias("failed"))


def vector_health(memories: DataFrame) -> DataFrame:
    """Zero vectors of either kind, and how many memories can be searched."""
    content, context = (F.forall(c, lambda x: x == 0) for c in ("content_embedding", "context_embedding"))
    return memories.agg(
        F.count("*").alias("total"),
        F.count_if(content).alias("zero_content"),
        F.count_if(context).alias("zero_context"),
        F.coalesce(F.avg(content.cast("int")) * 100, F.lit(0.0)).alias("zero_content_percent"),
        F.coalesce(F.avg(context.cast("int")) * 100, F.lit(0.0)).alias("zero_context_percent"),
        F.count_if(~content).alias("effective"),
    )


def store_stats(memories: DataFrame) -> DataFrame:
    """Memories, conversations, earliest and latest start, and the vectors' dimension; zeros if empty."""
    return memories.agg(
        F.count("*").alias("memories"),
        F.countDistinct("conversation_name").alias("conversations"),
        F.coalesce(F.min("start_timestamp"), F.lit(0)).alias("earliest"),
        F.coalesce(F.max("start_timestamp"), F.lit(0)).alias("latest"),
        F.coalesce(F.max(F.size("content_embedding")), F.lit(0)).alias("dimension"),
    )
