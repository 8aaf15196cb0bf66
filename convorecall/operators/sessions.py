"""Sessions of conversations: split at gaps and at a cap, short batches glued to what follows, overlaps at boundaries.

Cutting is a state machine over the messages of a conversation, whose state is the length of the current batch: its slot.
Messages are sorted by ranges of conversation and place, so a long conversation lies in many chunks. A chunk is summed up as a
map from the slot at its beginning to the slot at its end and the batches begun on the way, one entry for each of the few
slots; the maps of a conversation are followed in order, which gives the slot that each chunk begins with, and then all
chunks number their batches at once. Inside a chunk, messages without a gap between them are a run, and a run is one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.functions.text import is_text_message, nickname, session_id, shortened
from convorecall.functions.times import context_text
from convorecall.schema import DEFAULTS
from convorecall.tables import written

CONVERSATION = ["conversation_key", "conversation_name", "conversation_type"]
#: A chunk: one conversation's messages in one range.
CHUNK = ["_part", "conversation_key"]


def _first_slot(slot, gap: bool, least: int, cap: int):
    """Slot of a run's first message after ``slot`` (a number or an array)."""
    return np.where(slot >= (least if gap else cap), 1, slot + 1)


def _maps(least: int, cap: int):
    """Sorted runs to one row a chunk: for each slot at its beginning, the slot at its end and the batches begun."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slots, begun = None, None, None
        for batch in batches:
            done: list[tuple] = []
            for part, name, number, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (part, name):
                    if key:
                        done.append((*key, slots.tolist(), begun.tolist()))
                    key, slots, begun = (part, name), np.arange(cap + 1), np.zeros(cap + 1, np.int64)
                first = _first_slot(slots, number > 0, least, cap)
                begun = begun + (first == 1) + (first + n - 2) // cap
                slots = (first + n - 2) % cap + 1
            yield _rows(done, batch.schema, ("slots", "begun"), pa.list_(pa.int64()))
        if key:
            yield _rows([(*key, slots.tolist(), begun.tolist())], batch.schema, ("slots", "begun"), pa.list_(pa.int64()))

    return run


def _rows(rows: list[tuple], schema: pa.Schema, names: tuple[str, ...], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of a chunk's part and conversation, typed as they came, and more columns of one kind."""
    kinds = [schema.field(0).type, schema.field(1).type, *[kind] * len(names)]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*schema.names[:2], *names])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' maps, sorted by conversation and part, to the slot and the number of batches before each chunk."""
    key, slot, number, started = None, 0, 0, False
    for batch in batches:
        done = []
        for part, name, slots, begun in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or name != key:
                key, slot, number, started = name, 0, 0, True
            done.append((part, name, slot, number))
            slot, number = slots[slot], number + begun[slot]
        yield _rows(done, batch.schema, ("slot", "number"), pa.int64())


def _firsts(least: int, cap: int):
    """Sorted runs with their chunk's slot and number to each run's first slot and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, count = None, 0, 0
        for batch in batches:
            done = []
            for part, name, number, n, slot, before in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (part, name):
                    key, at, count = (part, name), slot, before
                first = int(_first_slot(at, number > 0, least, cap))
                count += first == 1
                done.append((part, name, number, first, count))
                count += (first + n - 2) // cap
                at = (first + n - 2) % cap + 1
            yield _rows(done, batch.schema, ("_run", "_first", "_count"), pa.int64())

    return run


def batches(messages: DataFrame, gap_seconds: int = DEFAULTS.gap_seconds, least: int = DEFAULTS.min_messages, most: int = DEFAULTS.max_messages) -> DataFrame:
    """Text messages with the number of their ``batch``: a new one begins after a gap or a full batch, if the current
    one has ``least`` messages. Order is that of ``seq``; a negative gap never splits. A conversation may be any share of all messages."""
    cap = max(least, most, 1)
    kept = messages.where(is_text_message(F.col("msg_type"), F.col("content")))
    kept = kept.repartitionByRange("conversation_key", "seq").sortWithinPartitions("conversation_key", "seq")
    kept = written(kept.withColumn("_at", F.monotonically_increasing_id()), "messages").withColumn("_part", F.shiftright("_at", 33))
    us = F.unix_micros("ts")
    ends = kept.groupBy(*CHUNK).agg(F.max_by(us, "_at").alias("_last"))
    ends = ends.select(*CHUNK, F.lag("_last").over(Window.partitionBy("conversation_key").orderBy("_part")).alias("_before"))
    order = Window.partitionBy(*CHUNK).orderBy("_at")
    gap = us - F.coalesce(F.lag(us).over(order), F.col("_before"))
    split = F.coalesce((gap > gap_seconds * 1_000_000).cast("long"), F.lit(0))
    kept = kept.join(ends, CHUNK).withColumn("_run", F.sum(split).over(order))
    runs = written(kept.groupBy(*CHUNK, "_run").agg(F.count("*").alias("_n")), "runs")
    kinds = "_part long, conversation_key string"
    maps = runs.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "_run").mapInArrow(_maps(least, cap), f"{kinds}, slots array<long>, begun array<long>")
    entries = maps.repartition("conversation_key").sortWithinPartitions("conversation_key", "_part").mapInArrow(_entries, f"{kinds}, slot long, number long")
    entered = runs.join(entries, CHUNK).select(*CHUNK, "_run", "_n", "slot", "number").repartition(*CHUNK).sortWithinPartitions(*CHUNK, "_run")
    firsts = entered.mapInArrow(_firsts(least, cap), f"{kinds}, _run long, _first long, _count long")
    place = F.row_number().over(Window.partitionBy(*CHUNK, "_run").orderBy("_at")) - 1
    numbered = kept.join(firsts, [*CHUNK, "_run"]).withColumn("batch", F.col("_count") + F.floor((F.col("_first") - 1 + place) / cap))
    return numbered.drop("_part", "_at", "_before", "_run", "_first", "_count")


def _described(df: DataFrame, kind: str) -> DataFrame:
    """Sessions with the columns that follow from their ``messages``."""
    df = df.withColumn("start_ts", F.col("messages")[0]["ts"]).withColumn("end_ts", F.element_at("messages", -1)["ts"])
    df = df.withColumn("participants", F.array_sort(F.array_distinct(F.transform("messages", lambda m: m["sender_name"]))))
    df = df.withColumn("message_count", F.size("messages")).withColumn("session_type", F.lit(kind))
    return df.withColumn("session_id", session_id(F.col("session_type"), F.unix_timestamp("start_ts"), F.unix_timestamp("end_ts")))


def main_sessions(messages: DataFrame, gap_seconds: int = DEFAULTS.gap_seconds, least: int = DEFAULTS.min_messages, most: int = DEFAULTS.max_messages) -> DataFrame:
    """Batches of at least ``least`` messages as sessions; only the last batch of a conversation can be shorter."""
    cut = batches(messages, gap_seconds, least, most)
    built = cut.groupBy(*CONVERSATION, "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "sender_name", "content"))).alias("messages"))
    return _described(built.where(F.size("messages") >= least), "main")


def overlap_sessions(main: DataFrame, least: int = DEFAULTS.min_messages, messages: int = DEFAULTS.overlap_messages, gap_seconds: int = DEFAULTS.overlap_gap_seconds) -> DataFrame:
    """The end of a session and the start of the next, if they are close in time."""
    # only a conversation's last batch can be missing, so the next session is that of the next number
    after = main.select("conversation_key", (F.col("batch") - 1).alias("batch"), F.col("start_ts").alias("after_ts"), F.slice("messages", 1, messages).alias("after"))
    near = main.join(after, ["conversation_key", "batch"]).where(F.unix_micros("after_ts") - F.unix_micros("end_ts") <= gap_seconds * 1_000_000)
    tail = F.slice("messages", F.greatest(F.size("messages") - messages + 1, F.lit(1)), messages)
    joined = near.select(*CONVERSATION, "batch", F.concat(tail, "after").alias("messages"))
    return _described(joined.where(F.size("messages") >= least), "overlap")


def sessions(messages: DataFrame, gap_seconds: int = DEFAULTS.gap_seconds, least: int = DEFAULTS.min_messages, most: int = DEFAULTS.max_messages) -> DataFrame:
    """Main and overlap sessions of messages."""
    main = written(main_sessions(messages, gap_seconds, least, most), "sessions")
    return main.unionByName(overlap_sessions(main, least))


def enriched(sessions_: DataFrame) -> DataFrame:
    """Sessions with ``content_text``, their dialogue, and ``context_text``, when and among whom it was."""
    line = lambda m: F.concat(nickname(m["sender_name"]), F.lit(": "), shortened(m["content"], DEFAULTS.max_chars))
    return sessions_.withColumn("content_text", F.array_join(F.transform("messages", line), "\n")).withColumn("context_text", context_text(F.col("start_ts"), F.col("participants")))


def with_neighbours(memories: DataFrame) -> DataFrame:
    """Main sessions with the content before and after them in their conversation."""
    order = Window.partitionBy("conversation_key").orderBy("start_ts", "session_id")
    main = memories.where("session_type = 'main'")
    return main.withColumn("context_before", F.lag("content_text").over(order)).withColumn("context_after", F.lead("content_text").over(order))
