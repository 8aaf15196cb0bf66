"""Intermediate tables in the shared folder, so that a lost executor costs only its own tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and all run on one machine (tests), a new one that is set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines share, as spark.master is {master or 'unset'}")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids, and of rows with a few columns, up to which a side of a join is sent to all executors; beyond it both sides are shuffled.
SMALL_ROWS, FEW_ROWS = 2_000_000, 500_000


def few(rows: DataFrame, name: str = "hits") -> DataFrame:
    """``rows`` of a few columns as a written table, with a broadcast hint if they are few enough, so that texts joined to them are not shuffled."""
    table = written(rows, name)
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with its rows' places, from 0, in the order of ``keys`` as column ``name``.

    Rows are sorted by ranges and counted by range; the only rows that meet in one task are the ranges' counts.
    """
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    ranges = rows.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("_part", (before - F.col("_first")).alias("_shift"))
    return rows.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for the one written last, which holds the result."""
    _SCOPES.append([])
    try:
        yield
    except BaseException:
        for path in _SCOPES.pop():
            removed(spark, path)
        raise
    *rest, result = _SCOPES.pop()
    for path in rest:
        removed(spark, path)
    if _SCOPES:
        _SCOPES[-1].append(result)
