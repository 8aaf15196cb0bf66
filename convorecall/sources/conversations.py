"""Reading conversations and messages, and writing lists and results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convorecall.schema import CONVERSATION


def read_conversations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per JSON file, keyed by its folder; a file that is no JSON has its text in ``_corrupt_record``."""
    df = spark.read.schema(CONVERSATION).json(paths, multiLine=True, mode="PERMISSIVE")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.url_decode(F.element_at(parts, -2)).alias("conversation_key"), F.col("_metadata.file_path").alias("file_path"))


def read_conversation_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of files with one conversation a line, keyed by its name: one file holds as many as one likes."""
    df = spark.read.schema(CONVERSATION).json(paths, mode="PERMISSIVE")
    return df.select("*", F.col("meta.name").alias("conversation_key"), F.col("_metadata.file_path").alias("file_path"))


def _matches(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Conversations under ``root``: ``x/x.json``, or ``x/y/y.json`` where ``x`` has none of its own; no dot folders."""

    def level(glob: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
        parts = F.split("path", "/")
        stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
        found = reader.load(f"{root}/{glob}").select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -3).alias("parent"), stem.alias("stem"))
        return found.where("folder = stem and not startswith(folder, '.') and not startswith(parent, '.')")

    def maybe(glob: str) -> DataFrame:
        return level(glob) if _matches(spark, f"{root}/{glob}") else spark.createDataFrame([], "path string, folder string, parent string, stem string")

    own = maybe("*/*.json")
    deeper = maybe("*/*/*.json").join(own.select(F.col("folder").alias("parent")), "parent", "left_anti")
    return own.select("path", "folder").unionByName(deeper.select("path", "folder"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The conversations that `discover` finds under ``root``, read as by `read_conversations`; a tree without any gives no rows.

    Both levels are read by their globs and joined with the files found, so that no list of files passes through the driver.
    """
    globs = [g for g in (f"{root}/*/*.json", f"{root}/*/*/*.json") if _matches(spark, g)]
    if not globs:
        return spark.createDataFrame([], CONVERSATION).select("*", F.lit("").alias("conversation_key"), F.lit("").alias("file_path"))
    same = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  one slash or three after the scheme
    found = discover(spark, root).select(same(F.col("path")).alias("_path"))
    return read_conversations(spark, globs).withColumn("_path", same(F.url_decode("file_path"))).join(found, "_path", "left_semi").drop("_path")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row's ``body`` as the file ``path`` below ``root``, and return their number; a task that runs again writes the same again.

    ``root`` is the URI of a file system that pyarrow opens. A null body is an empty file; rows with a null
    path are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return files.where("path is not null").select("path", "body").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def valid(conversations: DataFrame) -> DataFrame:
    """Conversations that could be read."""
    return conversations.where("_corrupt_record is null").drop("_corrupt_record")


def bad_files(conversations: DataFrame) -> DataFrame:
    """``bad_files, read_files``: conversations that could not be read, and those that could.

    Take both columns, or keep the conversations first: Spark does not read raw JSON for its faults alone.
    """
    return conversations.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad_files"), F.count("meta").alias("read_files"))


def messages_of(conversations: DataFrame) -> DataFrame:
    """One row per message, in the order of the file."""
    df = conversations.select("conversation_key", F.coalesce("meta.name", F.lit("Unknown")).alias("conversation_name"), F.coalesce("meta.type", F.lit("unknown")).alias("conversation_type"), F.posexplode("messages").alias("seq", "m"))
    return df.select("conversation_key", "conversation_name", "conversation_type", F.col("seq").cast("bigint").alias("seq"), F.col("m.sender").alias("sender"), F.coalesce("m.accountName", "m.sender").alias("sender_name"), F.timestamp_seconds("m.timestamp").alias("ts"), F.coalesce("m.content", F.lit("")).alias("content"), F.coalesce("m.type", F.lit(0)).alias("msg_type"))


def read_tabular(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Messages of ``csv`` (with a header), ``json`` or ``parquet`` files with ``content, timestamp, sender_name`` and maybe ``conversation_name, msg_type``."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if form == "csv" else spark.read
    return tabular_messages(reader.format(form).load(path))


def tabular_messages(df: DataFrame) -> DataFrame:
    """Messages of a table with ``content, timestamp, sender_name`` and maybe ``conversation_name, msg_type``."""
    name = F.col("conversation_name") if "conversation_name" in df.columns else F.lit("default")
    kind = F.col("msg_type").cast("int") if "msg_type" in df.columns else F.lit(0)
    df = df.select(F.coalesce(name, F.lit("default")).alias("conversation_key"), F.col("timestamp").cast("timestamp").alias("ts"), "sender_name", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(kind, F.lit(0)).alias("msg_type"))
    seq = F.row_number().over(Window.partitionBy("conversation_key").orderBy("ts", "sender_name", "content")) - 1
    return df.select("conversation_key", F.col("conversation_key").alias("conversation_name"), F.lit("private").alias("conversation_type"), seq.cast("bigint").alias("seq"), F.col("sender_name").alias("sender"), "sender_name", "ts", "content", "msg_type")


def write_list(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a clean-up list or evaluation results as ``json``, ``csv`` or ``parquet``."""
    df.write.format(form).option("header", True).mode("overwrite").save(path)
