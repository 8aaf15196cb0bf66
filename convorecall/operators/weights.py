"""How far first hits stand out, for all fusion weights at once.

Under the weight w of the keyword score, a memory's score is a line in w. A query's first and third scores are levels of its
lines, which change at crossings only, so the mean over queries of their difference is a curve of straight pieces. A
memory that three others equal or beat in both scores is in no query's first three whatever the weight: each task keeps the
others of its memories, a few for each query, and the pieces of a query are worked out from those. The curve is the running
sum of what all queries' pieces change, over ranges of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.tables import written

#: Hits that are compared: the first and this one, which counts as 0 where there are fewer.
THIRD = 3


def _band(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Places of the memories that fewer than ``THIRD`` others equal or beat in both scores; of equal ones the first count as better."""
    best, kept = [], []
    for i in np.lexsort((-vectors, -words)):
        if len(best) < THIRD or vectors[i] > best[0]:
            kept.append(i)
            best = sorted([*best, vectors[i]])[-THIRD:]
    return np.array(kept, np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: each query's memories that may be among its first three."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        query, words, vectors = (batch.column(c).to_numpy() for c in range(3))
        order = np.argsort(query, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
            if len(own):
                key = int(query[own[0]])
                lines = [np.concatenate(x) for x in zip(held.get(key, ((), ())), (words[own], vectors[own]))]
                keep = _band(*lines)
                held[key] = lines[0][keep], lines[1][keep]
    keys = [k for k, (w, _) in held.items() for _ in w]
    both = [np.concatenate([x[c] for x in held.values()]) if held else np.zeros(0) for c in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, both)], names=["query_id", "bm25_norm", "vector"])


def pieces(words: np.ndarray, vectors: np.ndarray) -> list[tuple[float, float, float]]:
    """(weight, constant, slope) of each straight piece of one query's difference of first and third score, from 0 on."""
    keep = _band(words, vectors)
    start, slope = vectors[keep], words[keep] - vectors[keep]
    rise = slope[None] - slope[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (start[:, None] - start[None]) / rise
    at = np.unique(np.concatenate([[0.0], cross[(rise != 0) & (cross > 0) & (cross < 1)]]))
    out: list[tuple[float, float, float]] = []
    for low, high in zip(at, [*at[1:], 1.0]):
        middle = start + slope * (low + high) / 2
        order = np.argsort(-middle, kind="stable")
        a, b = start[order[0]], slope[order[0]]
        if len(order) >= THIRD:
            a, b = a - start[order[THIRD - 1]], b - slope[order[THIRD - 1]]
        if not out or (a, b) != out[-1][1:]:
            out.append((float(low), float(a), float(b)))
    return out


def _changes(table: pa.Table) -> pa.Table:
    """What one query's pieces change in constant and slope, at their weights."""
    words, vectors = (table.column(c).to_numpy() for c in ("bm25_norm", "vector"))
    at, a, b = (np.array(x) for x in zip(*pieces(words, vectors)))
    return pa.table({"weight": at, "constant": np.diff(a, prepend=0.0), "slope": np.diff(b, prepend=0.0)})


def curve(parts: DataFrame) -> DataFrame:
    """``weight, constant, slope, avg_diff`` of the mean over queries: from ``weight`` to the next row's (or 1) it is ``constant + slope * w``.

    ``parts`` are those of `search.components` for k = 3 or more: whatever can be among a query's first three under a
    weight from 0 to 1. Queries without any hit do not count; without queries there are no rows.
    """
    bands = written(parts.select(F.col("query_id").cast("long").alias("query_id"), "bm25_norm", "vector").mapInArrow(_bands, "query_id long, bm25_norm double, vector double"), "bands")
    n = bands.select("query_id").distinct().count()
    change = bands.groupBy("query_id").applyInArrow(_changes, "weight double, constant double, slope double")
    change = change.groupBy("weight").agg(F.sum("constant").alias("constant"), F.sum("slope").alias("slope"))
    # running sums: inside ranges of weights, and over the ranges
    change = written(change.repartitionByRange("weight").withColumn("part", F.spark_partition_id()), "changes")
    parts_ = change.groupBy("part").agg(F.sum("constant").alias("c"), F.sum("slope").alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts_ = parts_.select("part", *[F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(x) for x in ("c", "s")])
    inside = Window.partitionBy("part").orderBy("weight")
    summed = change.join(F.broadcast(parts_), "part").select("weight", *[((F.sum(x).over(inside) + F.col(y)) / max(n, 1)).alias(x) for x, y in (("constant", "c"), ("slope", "s"))])
    return summed.withColumn("avg_diff", F.col("constant") + F.col("slope") * F.col("weight"))


def at_weights(curve_: DataFrame, weights: DataFrame) -> DataFrame:
    """``bm25_weight, avg_diff``: the curve at a few given weights from 0 to 1."""
    met = curve_.join(F.broadcast(weights.select("bm25_weight")), F.col("weight") <= F.col("bm25_weight"))
    last = met.groupBy("bm25_weight").agg(F.max_by(F.struct("constant", "slope"), "weight").alias("p"))
    return last.select("bm25_weight", (F.col("p.constant") + F.col("p.slope") * F.col("bm25_weight")).alias("avg_diff"))


def best_interval(curve_: DataFrame, slack: float = 1e-12) -> DataFrame:
    """One row: the largest mean difference, and the least and greatest weight that has it (all between too, if they are of one piece)."""
    end = curve_.agg(F.max_by(F.col("constant") + F.col("slope"), "weight").alias("avg_diff")).select(F.lit(1.0).alias("weight"), "avg_diff").where("avg_diff is not null")
    points = written(curve_.select("weight", "avg_diff").unionByName(end), "points")
    best = points.agg(F.max("avg_diff").alias("best"))
    return points.crossJoin(F.broadcast(best)).where(F.col("avg_diff") >= F.col("best") - slack).agg(F.max("best").alias("avg_diff"), F.min("weight").alias("from_weight"), F.max("weight").alias("to_weight"))  # one row
