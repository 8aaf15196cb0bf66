"""The store of memories and its index tables, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convorecall.tables import removed

BUCKETS = 64
#: Tables of a text index that are stored.
TABLES = ("postings", "term_stats", "corpus_stats")


def with_bucket(memories: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Memories with the bucket of their conversation."""
    return memories.withColumn("conv_bucket", F.pmod(F.xxhash64("conversation_key"), F.lit(buckets)).cast("int"))


def save(memories: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write all memories, one directory per bucket of conversations; a conversation without sessions leaves nothing."""
    with_bucket(memories, buckets).repartition("conv_bucket").write.mode("overwrite").partitionBy("conv_bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read all buckets as one table."""
    return spark.read.parquet(path)


def refresh(spark: SparkSession, path: str, fresh: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the conversations of ``fresh`` in the store; buckets without any of them are not touched.

    The rewritten buckets are staged beside the store first, as a table can't be read while it is overwritten.
    """
    fresh = with_bucket(fresh, buckets)
    touched = fresh.select("conv_bucket").distinct()
    old = load(spark, path).join(touched, "conv_bucket", "left_semi").join(fresh.select("conversation_key").distinct(), "conversation_key", "left_anti")
    staged = f"{path.rstrip('/')}.staged"
    old.unionByName(fresh).write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).repartition("conv_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("conv_bucket").parquet(path)
    removed(spark, staged)


def save_index(index: dict[str, DataFrame], path: str) -> None:
    """Write the tables of a text index; postings are sorted by term, so that a look-up skips row groups."""
    for name in TABLES:
        df = index[name]
        df = df.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else df
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read a text index."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
