"""Benchmark decontamination with DataFrame functions only.

A window of a document is compared with an item of its own size in words. Windows are laid where a five-word shingle of
the item occurs in the document, so that the two would line up; one that shares no shingle has similarity 0. Windows
and items get 64-bit SimHash fingerprints of their weighted shingles. Fingerprints are cut into one block more than
the radius has bits: two within the radius agree in a block. A window meets the items that it was laid for in the blocks
in which they agree, and what lies within the radius is verified by the exact weighted Jaccard similarity of the shingle
sets. So a window never meets an item that it shares nothing with, however many items have its size.

A shingle weighs log(1 + items / items with it), so that phrases of many items count less; one of no item weighs as
much as one of a single item. At a similarity of 0.8 the fingerprints differ in ten bits on average; the radius of 19 is over
three standard deviations above. An item of fewer than five words has one shingle, all its words in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.llm.scratch import SMALL_ROWS, small, written

SHINGLE = 5
RADIUS = 19
SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``x.words``; the explode keeps the words from being split again at each use."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), SPACE, -1), "")
    return df.select(F.col(key).cast("long").alias(key), F.explode(F.array(F.struct(words.alias("words")))).alias("x"))


def _shingles(words: str, size: int = SHINGLE) -> Column:
    at = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"if(size({words}) < {size}, cast(array() as array<long>), transform(sequence(0, size({words}) - {size}), i -> xxhash64({at})))")


def _by_size(words: str, n_words: str) -> Column:
    """Shingles of words, of which the item that they are compared with has ``n_words``."""
    out = F.when(F.col(n_words) >= SHINGLE, _shingles(words))
    for size in range(1, SHINGLE):
        out = out.when(F.col(n_words) == size, _shingles(words, size))
    return out


def _fingerprint() -> Column:
    """SimHash of the rows of a group: bit b is set if the shingles with that bit outweigh those without."""
    parts = [f"if(sum(if(shiftright(g, {b}) & 1 = 1, w, -w)) > 0, shiftleft(1L, {b}), 0L)" for b in range(64)]
    return F.expr(" | ".join(parts))


def _blocks() -> Column:
    """(number, value) of each block of ``code``: RADIUS + 1 blocks, as even as can be."""
    n = RADIUS + 1
    bounds = [64 * k // n for k in range(n + 1)]
    parts = [f"struct({k} as block, shiftrightunsigned(code, {a}) & {(1 << (b - a)) - 1}L as value)" for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    return F.expr(f"array({', '.join(parts)})")


def find(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Items found in documents: ``doc_id, item_id, start, n_words, similarity``, one row per document and item.

    Takes ``doc_id, text`` of documents and ``item_id, text`` of items; other columns are not read. ``start`` is the first
    word (from 0) of the most similar window, the first of equals; words are parted by ASCII white space and A-Z lower-cased.
    An item of fewer than five words is found where all of them stand in a row; null and empty texts contain nothing and
    are contained in nothing. Texts of any length are read whole. Rows with the same doc_id count as one document's, and
    rows with the same item_id as variants of one item. Empty tables give no rows.
    """
    item_words = _words(items, "item_id").where("item_id is not null and size(x.words) > 0")
    item_words = item_words.select("item_id", "x", F.xxhash64("item_id", "x.words").alias("variant"), F.size("x.words").alias("n_words")).dropDuplicates(["variant"])
    placed = item_words.select("item_id", "variant", "n_words", F.posexplode(_by_size("x.words", "n_words")).alias("item_at", "g"))
    placed = written(placed, "item_shingles")
    total = placed.agg(F.countDistinct("variant").alias("items"))
    weight = placed.groupBy("g").agg(F.countDistinct("variant").alias("df")).crossJoin(F.broadcast(total))  # one row
    weight = written(weight.select("g", F.log(1 + F.col("items") / F.col("df")).alias("w")), "weights")
    most = F.log(1 + F.col("items"))

    sizes = sorted({min(r.n_words, SHINGLE) for r in placed.select(F.least("n_words", F.lit(SHINGLE)).alias("n_words")).distinct().collect()})  # five at most
    words = _words(docs, "doc_id").where("doc_id is not null")
    seeds = None
    for size in sizes:
        spread = words.select("doc_id", F.posexplode(_shingles("x.words", size)).alias("at", "g"))
        own = placed.where(F.least("n_words", F.lit(SHINGLE)) == size)
        met = spread.join(small(own), "g").select("doc_id", "variant", "n_words", F.greatest(F.col("at") - F.col("item_at"), F.lit(0)).alias("start"))
        seeds = met if seeds is None else seeds.unionByName(met)
    if seeds is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, similarity double")
    seeds = written(seeds.distinct(), "seeds")
    laid = written(seeds.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("windows")), "windows")
    few = laid.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0)).alias("n")).first().n <= SMALL_ROWS
    laid = F.broadcast(laid) if few else laid
    window = words.join(laid, "doc_id").select("doc_id", "x", F.explode("windows").alias("v"))
    window = window.select("doc_id", "v.start", "v.n_words", F.explode(F.array(F.struct(F.expr("slice(x.words, v.start + 1, v.n_words)").alias("words")))).alias("x"))
    window = window.select("doc_id", "start", "n_words", F.explode(F.array_distinct(_by_size("x.words", "n_words"))).alias("g"))
    window = window.join(small(weight), "g", "left").crossJoin(F.broadcast(total)).select("doc_id", "start", "n_words", "g", F.coalesce("w", most).alias("w"))
    window = written(window.distinct(), "window_shingles")

    own = written(placed.select("item_id", "variant", "g").distinct().join(small(weight), "g"), "own")
    item_code = own.groupBy("item_id", "variant").agg(_fingerprint().alias("item_code"), F.sum("w").alias("item_weight"))
    item_code = written(item_code, "item_codes")
    code = window.groupBy("doc_id", "start", "n_words").agg(_fingerprint().alias("code"), F.sum("w").alias("window_weight"))
    code = written(code, "window_codes")
    left = seeds.join(code, ["doc_id", "start", "n_words"]).withColumn("b", F.explode(_blocks()))
    right = item_code.withColumnRenamed("item_code", "code").select("item_id", "variant", F.col("code").alias("item_code"), "item_weight", F.explode(_blocks()).alias("b"))
    near = left.join(right, ["variant", "b"]).where(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= RADIUS)
    near = near.select("doc_id", "start", "n_words", "item_id", "variant", "window_weight", "item_weight").distinct()

    both = near.join(window, ["doc_id", "start", "n_words"]).join(small(own).select("variant", "g"), ["variant", "g"])
    met = both.groupBy("doc_id", "start", "n_words", "item_id", "variant", "window_weight", "item_weight").agg(F.sum("w").alias("inter"))
    met = met.withColumn("similarity", F.col("inter") / (F.col("window_weight") + F.col("item_weight") - F.col("inter")))
    met = met.where(F.col("similarity") >= similarity - 1e-9)
    best = F.min_by(F.struct("start", "n_words", "similarity"), F.struct(-F.round("similarity", 9), "start"))
    return met.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.start", "best.n_words", F.round("best.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item; all their columns stay."""
    found = written(find(docs, items, similarity).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    return docs.join(small(found), F.col("doc_id") == F.col("_found"), "left_anti")
