"""A text index in segments, which follows the store's refreshes without being built again.

A refresh writes one new segment: the postings of the new memories, tombstones for the replaced ones in the segments that
hold them, and what both change in document frequencies, number and length. Statistics are the sums of all segments'
changes. While the last segment but one has fewer than twice the memories of the last, both are merged into one, without what
tombstones hide; all other segments keep their files. A list of the segments is written last, as a new version.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convorecall.functions.text import tokens
from convorecall.operators.search import index_of
from convorecall.tables import written

_LIST = "position int, segment string, memories long, n long, length long"
_TABLES = {
    "postings": "term string, memory_key long, dl int, tf long",
    "forward": "conversation_key string, memory_key long, dl int, terms array<string>",
    "changes": "term string, df long",
    "tombstones": "segment string, memory_key long",
}


def segments(spark: SparkSession, path: str) -> list:
    """The segments of the newest version: name, memories at its writing, and what it changes in the number and length of all."""
    rows = spark.read.schema(f"{_LIST}, version int").json(f"{path}/segments")
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).orderBy("position").collect()  # a logarithm of the refreshes


def _publish(spark: SparkSession, path: str, version: int, found: list[tuple]) -> None:
    rows = [(i, *x) for i, x in enumerate(found)]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.json(f"{path}/segments/version={version}")


def _version(spark: SparkSession, path: str) -> int:
    return spark.read.schema(f"{_LIST}, version int").json(f"{path}/segments").agg(F.max("version")).first()[0]


def _table(spark: SparkSession, path: str, name: str, own: list[str]) -> DataFrame:
    """A table of some segments, with the segment of each row."""
    read = [spark.read.schema(_TABLES[name]).parquet(f"{path}/{segment}/{name}").withColumn("segment_", F.lit(segment)) for segment in own]
    return reduce(DataFrame.unionByName, read)


def _alive(spark: SparkSession, path: str, name: str, own: list[str], every: list[str]) -> DataFrame:
    """Rows of some segments that no tombstone of any segment hides; few memories are hidden before a merge forgets them."""
    gone = _table(spark, path, "tombstones", every).where(F.col("segment").isin(own)).select(F.col("segment").alias("segment_"), "memory_key").distinct()
    return _table(spark, path, name, own).join(gone, ["segment_", "memory_key"], "left_anti").drop("segment_")


def _write(path: str, segment: str, forward: DataFrame, postings: DataFrame, changes: DataFrame, tombstones: DataFrame) -> None:
    forward.write.parquet(f"{path}/{segment}/forward")
    postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{segment}/postings")
    changes.write.parquet(f"{path}/{segment}/changes")
    tombstones.write.parquet(f"{path}/{segment}/tombstones")


def _add(spark: SparkSession, path: str, memories: DataFrame, gone: DataFrame) -> tuple:
    """Write a segment of ``memories`` in place of ``gone`` (segment_ and the forward columns); its row in the list."""
    segment = f"segment-{uuid.uuid4().hex}"
    terms = written(memories.select("conversation_key", "memory_key", tokens(F.col("content_text")).alias("terms")), "terms")
    forward = terms.select("conversation_key", "memory_key", F.size("terms").alias("dl"), F.array_distinct("terms").alias("terms"))
    postings = terms.select("memory_key", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", "memory_key", "dl").agg(F.count("*").alias("tf"))
    count = lambda df, sign: df.select(F.explode("terms").alias("term"), F.lit(sign).alias("one"))
    changes = count(forward, 1).unionByName(count(gone, -1)).groupBy("term").agg(F.sum("one").cast("long").alias("df")).where("df <> 0")
    _write(path, segment, forward, postings, changes, gone.select(F.col("segment_").alias("segment"), "memory_key"))
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")]
    new, old = forward.agg(*sums).first(), gone.agg(*sums).first()
    return segment, new.n, new.n - old.n, new.length - old.length


def create(memories: DataFrame, path: str) -> None:
    """Index memories (``conversation_key, memory_key, content_text``) as one segment."""
    spark = memories.sparkSession
    none = spark.createDataFrame([], f"segment_ string, {_TABLES['forward']}")
    _publish(spark, path, 0, [_add(spark, path, memories, none)])


def refresh(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Replace the conversations of ``fresh`` by its memories, then merge segments of like sizes."""
    found = [(s.segment, s.memories, s.n, s.length) for s in segments(spark, path)]
    names = [s for s, *_ in found]
    replaced = fresh.select("conversation_key").distinct()
    hidden = _table(spark, path, "tombstones", names).select(F.col("segment").alias("segment_"), "memory_key").distinct()
    gone = _table(spark, path, "forward", names).join(replaced, "conversation_key", "left_semi").join(hidden, ["segment_", "memory_key"], "left_anti")
    found.append(_add(spark, path, fresh, written(gone.select("segment_", "conversation_key", "memory_key", "dl", "terms"), "gone")))
    every = [s for s, *_ in found]
    while len(found) > 1 and found[-2][1] < 2 * found[-1][1]:
        found[-2:] = [_merged(spark, path, found[-2:], every)]
        every.append(found[-1][0])
    _publish(spark, path, _version(spark, path) + 1, found)


def _merged(spark: SparkSession, path: str, two: list[tuple], every: list[str]) -> tuple:
    """Two segments as a new one: what is alive, the sums of their changes, and their tombstones on other segments."""
    segment, own = f"segment-{uuid.uuid4().hex}", [s for s, *_ in two]
    forward = written(_alive(spark, path, "forward", own, every), "forward")
    changes = _table(spark, path, "changes", own).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    tombstones = _table(spark, path, "tombstones", own).where(~F.col("segment").isin(own)).drop("segment_")
    _write(path, segment, forward, _alive(spark, path, "postings", own, every), changes, tombstones)
    return segment, forward.count(), sum(x[2] for x in two), sum(x[3] for x in two)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a text index as `search.build_index` gives them, from the newest version."""
    found = segments(spark, path)
    names = [s.segment for s in found]
    df = _table(spark, path, "changes", names).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    n, length = sum(s.n for s in found), sum(s.length for s in found)
    sizes = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(length / n if n else None).cast("double").alias("avgdl"))
    return index_of(_alive(spark, path, "postings", names, names), df, sizes)
