"""Hybrid top-k by the threshold algorithm over two sorted lists.

A query has a list of memories by keyword score and one by vector score. Both are read to a depth, each row with its other
score, and no memory that was not met can score more than the weighted scores at which the lists were left. A query whose
k-th best is above that is done; of the others, the lists are read on to the scores at which no memory left can reach their
k-th best so far. Both lists come from products of a slice of memories and a block of queries, so that a row's other score
is at hand where it is read, and neither postings nor pairs are joined: a task sends the beginnings of its lists, then no
more than a few best that reach the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.operators.blockmax import PLACES
from convorecall.operators.products import Asked
from convorecall.operators.search import _FOUND, NONE, Best, Sought, _block, _column, _fusing, _in_few_tasks, _over, _searched, _slices, _words, top, worded
from convorecall.schema import DEFAULTS
from convorecall.tables import written

#: How many times k the lists are read at first, and times the depth at which `report` looks next.
FIRST, DEEPER = 4, 4
#: What scores summed in another order may differ by.
SLACK = 1e-9
#: Depth to which `report` orders scores at first, and scores of a block of queries that a task holds for it.
ORDERED, HELD = 1280, 1_000_000


def _both(frame: pa.RecordBatch, sought: Sought, words) -> tuple[np.ndarray, ...]:
    """[memory, query]: places in the keyword list and in the vector list (-inf for what is in none), keyword, content and vector scores, and whether filters are passed."""
    content, vector = sought.vectors(frame)
    score, hit = words(frame)
    ok = sought.passing(frame)
    if (none := sought.without(frame)) is not None:
        vector = np.where(none, NONE, vector)
    return np.where(hit, score.round(PLACES), -np.inf), np.where(ok, vector, -np.inf), score, content, vector, ok


_LISTS = "query_id long, memory_key long, words boolean, place double, bm25 double, content_score double, vector double, passes boolean"


def _lists(block: pa.Table, asked: Asked, depth: int, weights: tuple[float, float, float, float]):
    """Per task: the first ``depth`` rows of each query's two lists, with both scores."""
    sought = Sought(block, *weights[2:])
    words = _words(asked, sought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Best(len(sought.ids), depth), Best(len(sought.ids), depth)
        for frame in _slices(batches, sought.rows):
            by_words, by_vector, score, content, vector, ok = _both(frame, sought, words)
            for own, place in zip(lists, (by_words, by_vector)):
                own.add(place, _column(frame, "memory_key").to_numpy(), bm25=score, content=content, vector=vector, ok=ok)
        for own, is_words in zip(lists, (True, False)):
            if (b := own.rows()) is not None:
                scores = (pa.array(x, pa.float64(), mask=b.vector == NONE) for x in (b.content, b.vector))
                columns = [pa.array(sought.ids[b.q], pa.int64()), pa.array(b.key, pa.int64()), pa.array(np.full(len(b), is_words)), pa.array(-b.v), pa.array(b.bm25), *scores, pa.array(b.ok)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "memory_key", "words", "place", "bm25", "content_score", "vector", "passes"])

    return run


def _of(ids: pa.Array, block: pa.Table, asked: Asked) -> tuple[pa.Table, Asked]:
    """What a block has on some of its queries."""
    own = [t.filter(pc.is_in(t.column("query_id"), value_set=ids.cast(t.schema.field("query_id").type))) for t in (block, asked.table())]
    return own[0], Asked(pa.table({"query_id": ids}), own[1])


_HITS = ("query_id", "rank", "memory_key", "score", "bm25_norm", "vector", "content_score")


def _found(m: DataFrame, block: pa.Table, asked: Asked, k: int, weights: tuple[float, float, float, float]) -> tuple[list[DataFrame], pa.Table]:
    """Of one block of queries: tables of each query's best k, and ``query_id, done, touched, largest, least``, after the first depth, of those with a list."""
    bm25_weight, vector_weight = weights[:2]
    depth = FIRST * k
    ranked = Window.partitionBy("query_id", "words").orderBy(F.desc("place"), "memory_key")
    lists = m.mapInArrow(_lists(block, asked, depth, weights), _LISTS).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= depth)
    lists = written(lists, "lists")
    last = F.col("rank") == depth
    state = lists.groupBy("query_id").agg(
        F.max(F.when(F.col("words"), F.col("bm25"))).alias("largest"),
        F.count(F.lit(1)).alias("touched"),
        F.max(F.when(F.col("words") & last, F.col("bm25"))).alias("word"),
        F.max(F.when(~F.col("words") & last, F.col("place"))).alias("vec"),
    )
    state = written(state.withColumn("word", F.coalesce(F.col("word") / _over(F.col("largest")), F.lit(0.0))), "state")
    met = lists.where("passes").dropDuplicates(["query_id", "memory_key"]).join(F.broadcast(state.select("query_id", "largest")), "query_id")  # a row a query of a block
    met = met.withColumn("bm25_norm", F.col("bm25") / _over(F.col("largest")))
    best = written(_top(met, k, weights), "best")
    # a vector list that ends above its depth has all memories; a keyword list that does has all that score above 0
    bound = bm25_weight * F.col("word") + vector_weight * F.col("vec")
    done = F.col("vec").isNull() | F.coalesce(F.col("least") > bound + SLACK, F.lit(False))
    state = state.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left")
    state = state.select("query_id", done.alias("done"), "touched", "largest", "least").toArrow().combine_chunks().sort_by("query_id")  # a row a query of a block
    rest = state.filter(pc.invert(state.column("done")))
    if not len(rest):
        return [best], state
    ids = rest.column("query_id").combine_chunks()
    block, asked = _of(ids, block, asked)
    tops, least = (rest.column(c).fill_null(-np.inf).to_numpy() for c in ("largest", "least"))
    more = written(_top(m.mapInArrow(_fusing(block, asked, tops, k, weights, least - SLACK), _FOUND), k, weights), "best")
    open_ids = best.sparkSession.createDataFrame(pa.table({"query_id": ids}))
    return [best.join(F.broadcast(open_ids), "query_id", "left_anti"), more], state


def _top(rows: DataFrame, k: int, weights: tuple[float, float, float, float]) -> DataFrame:
    scored = rows.withColumn("score", weights[0] * F.col("bm25_norm") + weights[1] * F.col("vector"))
    return top(scored.withColumn("near", F.round("score", 12)), "near", k).select(*_HITS)


def _begin(memories: DataFrame, index: dict[str, DataFrame], blocks: dict[str, DataFrame], queries: DataFrame, weights: tuple[float, float, float, float]) -> tuple[DataFrame, list[tuple[DataFrame, Asked]]]:
    if min(weights[:2]) < 0 or (index["corpus_stats"].first()["avg_idf"] or 0) < 0:
        raise ValueError("the threshold needs weights and keyword scores that are not negative")
    queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
    return _in_few_tasks(_searched(memories, blocks["counted"], index)), worded(queries, blocks["ids"], F.col("qtf") * F.col("idf"))


def search(memories: DataFrame, index: dict[str, DataFrame], blocks: dict[str, DataFrame], queries: DataFrame, k: int = 5, bm25_weight: float = DEFAULTS.bm25_weight, vector_weight: float = DEFAULTS.vector_weight, content_weight: float = DEFAULTS.content_weight, context_weight: float = DEFAULTS.context_weight) -> DataFrame:
    """``query_id, rank, memory_key, score, bm25_norm, vector, content_score``: the rows of `search.hybrid_search`.

    ``blocks`` are those of `blockmax.build` on ``index``. Queries that no memory passes the filters of have no rows.
    """
    weights = (bm25_weight, vector_weight, content_weight, context_weight)
    m, asked_for = _begin(memories, index, blocks, queries, weights)
    return reduce(DataFrame.unionByName, [hits for q, asked in asked_for for hits in _found(m, _block(q), asked, k, weights)[0]])


_ORDERED = "query_id long, largest double, least double, words array<double>, vectors array<double>, hits long, passing long"


def _ordered(block: pa.Table, asked: Asked, tops: np.ndarray, least: np.ndarray, most: int, spare: int, weights: tuple[float, float, float, float]):
    """Per task: the scores of the beginnings of each query's two lists, and how many rows they have.

    At most ``most`` scores a list, and no more than ``spare`` times those that it takes until a task's own lists, read alike,
    fall below the query's k-th best.
    """
    sought = Sought(block, *weights[2:])
    words = _words(asked, sought)
    over = np.where(tops > 0, tops, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(sought.ids)
        lists, held = [np.full((most, n), -np.inf)] * 2, np.zeros((2, n), np.int64)
        for frame in _slices(batches, sought.rows):
            both = _both(frame, sought, words)[:2]
            held += [(x > -np.inf).sum(0) for x in both]
            lists = [np.partition(np.concatenate([own, x]), len(x), axis=0)[len(x) :] for own, x in zip(lists, both)]
        lists = [-np.sort(-own, axis=0).T for own in lists]
        filled = [np.where(own > -np.inf, own, rest) for own, rest in zip(lists, (0.0, NONE))]
        below = weights[0] * filled[0] / over[:, None] + weights[1] * filled[1] + SLACK < least[:, None]
        far = np.where(below.any(1), spare * (below.argmax(1) + 4), most)
        ends = [np.minimum(np.minimum(far, most), x) for x in held]
        arrays = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(end)).astype(np.int32)), pa.array(scores[np.arange(most) < end[:, None]])) for scores, end in zip(filled, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(sought.ids, pa.int64()), pa.array(tops), pa.array(least), *arrays, *map(pa.array, held)], names=["query_id", "largest", "least", "words", "vectors", "hits", "passing"])

    return run


def _settled(begin: int, weights: tuple[float, float, float, float]):
    """One query's rows of all tasks -> ``query_id, depth, touched``; a null depth if the tasks sent too little to tell."""

    def run(table: pa.Table) -> pa.Table:
        tops, least = table.column("largest")[0].as_py(), table.column("least")[0].as_py()
        sizes, lists, cuts = [], [], []
        for name, total in (("words", "hits"), ("vectors", "passing")):
            rows, all_ = [np.array(x) for x in table.column(name).to_pylist()], table.column(total).to_pylist()
            sizes.append(sum(all_))
            lists.append(-np.sort(-np.concatenate(rows)))
            cuts.append(max([x[-1] if len(x) else np.inf for x, n in zip(rows, all_) if len(x) < n], default=-np.inf))  # what a task kept back is no higher
        depth, touched = begin, None
        while True:
            if depth > sizes[1]:
                break
            known = [depth > size or (depth <= len(x) and x[depth - 1] >= cut) for size, x, cut in zip(sizes, lists, cuts)]
            if not all(known):
                depth = None
                break
            word = 0.0 if depth > sizes[0] else lists[0][depth - 1] / (tops if tops > 0 else 1.0)
            if least > weights[0] * word + weights[1] * lists[1][depth - 1] + SLACK:
                break
            depth *= DEEPER
        touched = None if depth is None else sum(min(depth, size) for size in sizes)
        return pa.table({"query_id": table.column("query_id")[:1], "depth": pa.array([depth], pa.int64()), "touched": pa.array([touched], pa.int64())})

    return run


def report(memories: DataFrame, index: dict[str, DataFrame], blocks: dict[str, DataFrame], queries: DataFrame, k: int = 5, bm25_weight: float = DEFAULTS.bm25_weight, vector_weight: float = DEFAULTS.vector_weight, content_weight: float = DEFAULTS.content_weight, context_weight: float = DEFAULTS.context_weight) -> DataFrame:
    """``query_id, depth, touched``: the depth, of ``FIRST`` k and times ``DEEPER``, at which the lists of each query can be left, and the rows of both together.

    That is the first depth at which no memory below can reach the k-th best of all. Of queries that go beyond the first, tasks
    send the scores of as much of their own lists as the depth is likely to ask for; if that does not tell, more.
    """
    weights = (bm25_weight, vector_weight, content_weight, context_weight)
    m, asked_for = _begin(memories, index, blocks, queries, weights)
    spark, tasks, held, out = queries.sparkSession, m.rdd.getNumPartitions(), m.count(), []
    for q, asked in asked_for:
        block = _block(q)
        hits, state = _found(m, block, asked, k, weights)
        done = state.filter(state.column("done")).select(["query_id", "touched"])
        absent = pa.table({"query_id": asked.ids}).join(state.select(["query_id"]), "query_id", join_type="left anti")
        first = [*done.to_pylist(), *({"query_id": x, "touched": 0} for x in absent.column("query_id").to_pylist())]
        if first:
            out.append(spark.createDataFrame(pa.table({"query_id": pa.array([r["query_id"] for r in first], pa.int64()), "depth": pa.array([FIRST * k] * len(first), pa.int64()), "touched": pa.array([r["touched"] for r in first], pa.int64())})))
        rest = state.filter(pc.invert(state.column("done")))
        if not len(rest):
            continue
        exact = hits[-1].where(F.col("rank") == k).select("query_id", F.col("score").alias("exact")).toArrow()  # a row a query of a block
        rest = rest.select(["query_id", "largest"]).join(exact, "query_id", join_type="left outer").combine_chunks().sort_by("query_id")
        target, spare = ORDERED, 2 * DEEPER
        while len(rest):
            most = min(target, DEEPER * target // tasks + 16, held)  # a task has no more than all memories, so this ends
            left = []
            for lo in range(0, len(rest), max(1, HELD // most)):
                some = rest.slice(lo, max(1, HELD // most))
                own = _of(some.column("query_id").combine_chunks(), block, asked)
                tops, least = (some.column(c).fill_null(-np.inf).to_numpy() for c in ("largest", "exact"))
                rows = m.mapInArrow(_ordered(*own, tops, least, most, spare, weights), _ORDERED)
                settled = written(rows.groupBy("query_id").applyInArrow(_settled(FIRST * k, weights), "query_id long, depth long, touched long"), "settled")
                out.append(settled.where("depth is not null"))
                left += settled.where("depth is null").select("query_id").toArrow().column("query_id").to_pylist()
            rest = rest.filter(pc.is_in(rest.column("query_id"), value_set=pa.array(left, rest.schema.field("query_id").type)))
            target, spare = target * DEEPER * DEEPER, spare * DEEPER * DEEPER
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, depth long, touched long")
    return found.select("query_id", F.col("depth").cast("int").alias("depth"), "touched")
