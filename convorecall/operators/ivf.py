"""Approximate search by an inverted file with product-quantised residuals.

Vectors of unit length go to the cell of their nearest centroid; what is left of a vector is cut into parts, each coded by
the nearest of a few words of that part. Centroids and words are k-means means over a bounded sample: tasks assign their
vectors and send sums, never vectors. The coded lists are written in ranges of cells, so that a search reads the row
groups of the cells that it probes and no others, and a large cell lies in many files. A query scores the codes of its
cells by tables of inner products, and by their vectors, which lie beside the codes, all those that the codes do not rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.operators.products import first
from convorecall.operators.search import _by_block, _matrix, cosine
from convorecall.tables import written

#: Vectors that training reads at most for each cell or word, and those among which first means are picked.
SAMPLE_EACH, SEEDS_EACH = 256, 32
#: Queries of one block: each has a table of ``parts * words`` numbers in every task.
BLOCK = 1000
#: Probed cells up to which the scan is told their numbers.
LISTED = 2000
#: What scores by codes, which are sums of short numbers, may be off.
SLACK = 1e-4


@dataclass
class Codebook:
    """Centroids [cell, width] and words [part, word, width of a part]; both bounded by parameters."""

    centroids: np.ndarray
    words: np.ndarray = field(default_factory=lambda: np.zeros((1, 1, 1)))

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Nearest centroid of each row."""
        return _nearest(unit, self.centroids)

    def parts(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """[row, part, number]: what the centroids leave, padded to whole parts."""
        n, (m, _, size) = len(unit), self.words.shape
        out = np.zeros((n, m * size))
        out[:, : self.width] = unit - self.centroids[cells]
        return out.reshape(n, m, size)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """[query, part, word]: inner products of the queries' parts and the words."""
        n, (m, _, size) = len(unit), self.words.shape
        out = np.zeros((n, m * size))
        out[:, : self.width] = unit
        return np.einsum("nms,mks->nmk", out.reshape(n, m, size), self.words)


def _nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Nearest mean of each row, the first of equal ones; a few thousand rows at a time."""
    half = (means * means).sum(1) / 2
    return np.concatenate([np.argmax(rows[lo : lo + 4096] @ means.T - half, axis=1) for lo in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


def _seeds(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First means: each the row, of a few drawn by their squared distance to those before, that leaves the least in sum."""
    means = np.zeros((k, rows.shape[1]))
    if not len(rows):
        return means
    far = np.full(len(rows), np.inf)
    for i in range(k):
        if i and far.sum() <= 1e-12:
            means[i:] = rows[rng.integers(len(rows), size=k - i)]
            break
        tries = rng.choice(len(rows), 8 if i else 1, p=far / far.sum() if i else None)
        left = np.minimum(far, ((rows[None] - rows[tries, None]) ** 2).sum(2)) if len(rows) * 8 * rows.shape[1] < 4_000_000 else np.stack([np.minimum(far, ((rows - rows[t]) ** 2).sum(1)) for t in tries])
        best = int(left.sum(1).argmin())
        means[i], far = rows[tries[best]], left[best]
    return means


def _spread(rows: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest mean of each row, its squared distance, and that of the second nearest."""
    far = np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ means.T + (means * means).sum(1), 0.0)
    two = np.partition(far, 1, axis=1) if len(means) > 1 else np.repeat(far, 2, axis=1)
    return far.argmin(1), two[:, 0], two[:, 1]


def _settled(rows: np.ndarray, means: np.ndarray, rounds: int) -> np.ndarray:
    """A few of Lloyd's rounds over rows at hand."""
    for _ in range(rounds):
        near = _spread(rows, means)[0]
        held, total = np.bincount(near, minlength=len(means)), np.zeros(means.shape)
        np.add.at(total, near, rows)
        means = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], means)
    return means


def _swapped(rows: np.ndarray, means: np.ndarray, tries: int = 5) -> np.ndarray:
    """First means after swaps: a mean that is missed least goes into a cell that is spread most, as long as the rows come nearer.

    Lloyd's rounds alone leave a cluster with two means and two clusters with one as they are.
    """
    if not len(rows):
        return means
    means = _settled(rows, means, 5)
    for _ in range(len(means)):
        near, least, second = _spread(rows, means)
        missed, spread = (np.bincount(near, x, len(means)) for x in (second - least, least))
        for i, j in ((i, j) for i in np.argsort(missed, kind="stable")[:tries] for j in np.argsort(-spread, kind="stable")[:tries] if i != j):
            if not spread[j] > 0:
                continue
            tried, own = means.copy(), np.flatnonzero(near == j)
            tried[i] = rows[own[least[own].argmax()]]
            tried = _settled(rows, tried, 5)
            if _spread(rows, tried)[1].sum() < least.sum() * (1 - 1e-6):
                means = tried
                break
        else:
            break
    return means


def _sums(shape: Callable[[np.ndarray], np.ndarray], means: np.ndarray, width: int):
    """Per task: number and sum of the rows nearest to each mean of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(means.shape), np.zeros(means.shape[:2], np.int64)
        for batch in batches:
            rows = shape(_matrix(batch.column(0), width))
            for part in range(len(means)):
                near = _nearest(rows[:, part], means[part])
                np.add.at(total[part], near, rows[:, part])
                count[part] += np.bincount(near, minlength=means.shape[1])
        at = np.flatnonzero(count.ravel())
        flat = total.reshape(-1, means.shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), pa.array([flat[i].tobytes() for i in at], pa.binary())], names=["mean", "n", "total"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sum of the tasks' sums for one mean."""
    total = np.sum([np.frombuffer(x) for x in table.column("total").to_pylist()], axis=0)
    return pa.table({"mean": table.column("mean")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "total": pa.array([total.tobytes()], pa.binary())})


def _means(sample: DataFrame, shape: Callable[[np.ndarray], np.ndarray], means: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds over the sample; a mean without rows stays where it is."""
    kind = "mean long, n long, total binary"
    for _ in range(rounds):
        moved = means.copy()
        for row in sample.mapInArrow(_sums(shape, means, width), kind).groupBy("mean").applyInArrow(_added, kind).collect():  # a row a mean
            moved[divmod(row.mean, means.shape[1])] = np.frombuffer(row.total) / row.n
        if np.array_equal(moved, means):
            break
        means = moved
    return means


def _drawn(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` vectors, in the order of a hash of their keys; of many more, the hash is bounded first."""
    order = F.pmod(F.xxhash64("memory_key", F.lit(seed)), F.lit(1 << 30))
    total = vectors.count()
    if total > 2 * n:
        vectors = vectors.where(order < int((1 << 30) * 1.5 * n / total) + 1)
    return vectors.orderBy(order, "memory_key").limit(n)


def train(memories: DataFrame, cells: int = 256, parts: int = 16, words: int = 256, rounds: int = 8, seed: int = 1) -> Codebook:
    """Centroids and words for the ``content_embedding`` of memories, from at most ``SAMPLE_EACH`` vectors for each of the more numerous.

    Null and empty vectors are left out; they, and zero vectors, are indexed in some cell all the same. Without any vector
    all means are zero.
    """
    vectors = memories.where(F.size("content_embedding") > 0).select("memory_key", "content_embedding")
    width = vectors.agg(F.max(F.size("content_embedding"))).first()[0] or 1
    most = max(cells, words)
    sample = written(_drawn(vectors, SAMPLE_EACH * most, seed).repartition("memory_key"), "sample")
    rng = np.random.default_rng(seed)
    drawn = _matrix(_drawn(sample, SEEDS_EACH * most, seed + 1).toArrow().column("content_embedding").combine_chunks(), width)  # bounded
    sample = sample.select("content_embedding")
    book = Codebook(_means(sample, lambda x: x[:, None], _swapped(drawn, _seeds(drawn, cells, rng))[None], width, rounds)[0])
    size = -(-width // parts)
    book.words = np.zeros((-(-width // size), words, size))
    left = book.parts(drawn, book.cells(drawn))
    seeds = np.stack([_seeds(left[:, p], words, rng) for p in range(left.shape[1])])
    book.words = _means(sample, lambda x: book.parts(x, book.cells(x)), seeds, width, rounds)
    return book


def _coded(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(1), book.width)
            cells = book.cells(unit)
            left = book.parts(unit, cells)
            codes = np.stack([_nearest(left[:, p], book.words[p]) for p in range(left.shape[1])], 1).astype("<u2")
            lost = left - np.stack([book.words[p][codes[:, p]] for p in range(left.shape[1])], 1)
            lost = np.sqrt((lost * lost).sum((1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost)], names=["cell", "memory_key", "content_embedding", "code", "lost"])

    return run


def index(memories: DataFrame, book: Codebook) -> DataFrame:
    """Coded lists of all memories, ``cell, memory_key, content_embedding, code, lost`` (length of what the code leaves out): a written table in ranges of cell and key."""
    coded = memories.select("memory_key", "content_embedding").mapInArrow(_coded(book), "cell long, memory_key long, content_embedding array<float>, code binary, lost double")
    return written(written(coded, "codes").repartitionByRange("cell", "memory_key").sortWithinPartitions("cell", "memory_key"), "lists")


def _scored(book: Codebook, unit: np.ndarray, ids: np.ndarray, asked: dict[int, np.ndarray], k: int, keep: int):
    """Per task: the ``keep`` best of each query.

    The ``keep`` best by their codes are scored by their vectors; of the others, those whose code and what it leaves out
    do not rule out the k best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, centre = book.tables(unit).astype(np.float32), (unit @ book.centroids.T).astype(np.float32)
        best: list[np.ndarray] = []
        for batch in batches:
            cells, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(len(keys), -1)
            lost, vectors = batch.column(3).to_numpy(), _matrix(batch.column(4), book.width)
            order = np.argsort(cells, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                queries = asked.get(int(cells[own[0]])) if len(own) else None
                if queries is None:
                    continue
                for lo in range(0, len(queries), 256):
                    q = queries[lo : lo + 256]
                    score = np.repeat(centre[q, cells[own[0]]][:, None], len(own), 1)
                    for p in range(codes.shape[1]):
                        score += tables[q, p][:, codes[own, p]]
                    for j, row in zip(q, score):
                        near = np.arange(len(own)) if len(own) <= keep else np.flatnonzero(row >= np.partition(row, -keep)[-keep])
                        value = vectors[own[near]] @ unit[j]
                        if len(near) < len(own):
                            kth = np.partition(value, -k)[-k] if len(near) >= k else -np.inf
                            near = np.union1d(near, np.flatnonzero(row + lost[own] >= kth - SLACK))
                            value = vectors[own[near]] @ unit[j]
                        if len(near) > keep:
                            high = value >= np.partition(value, -keep)[-keep] - SLACK
                            near, value = near[high], value[high]
                        best.append(np.rec.fromarrays([np.full(len(near), j), -value, keys[own[near]], np.full(len(near), cells[own[0]])], names="q,v,key,c"))
            if sum(map(len, best)) > 4 * keep * len(ids) + 100_000:
                best = [first(np.concatenate(best), keep)]
        if best:
            b = first(np.concatenate(best), keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[b.q], pa.int64()), pa.array(b.c, pa.int64()), pa.array(b.key, pa.int64()), pa.array(-b.v, pa.float64())], names=["query_id", "cell", "memory_key", "rough"])

    return run


def probed(book: Codebook, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, cell``: the cells whose centroids are nearest in angle to each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_matrix(batch.column(1), book.width) @ book.centroids.T), axis=1, kind="stable")[:, :probes]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel())], names=["query_id", "cell"])

    return queries.select("query_id", "content_vec").mapInArrow(run, "query_id long, cell long")


def search(lists: DataFrame, book: Codebook, queries: DataFrame, k: int = 10, probes: int = 8, keep: int = 100) -> DataFrame:
    """``query_id, memory_key, vector, rank``: the ``k`` best by cosine in the ``probes`` cells of each query.

    Codes only leave out what cannot be among them; ``keep`` (at least k) rows a query and task are scored by their vectors at first.
    Queries go block by block; a null or zero vector finds whatever its cells hold. Repeated keys are ranked one by one.
    """

    keep = max(k, keep)

    def block(asked: DataFrame) -> DataFrame:
        rows = asked.select("query_id", "content_vec").toArrow().combine_chunks().sort_by("query_id")  # a counted block
        ids = rows.column("query_id").to_numpy()
        unit = _matrix(rows.column("content_vec").combine_chunks(), book.width)
        near = np.argsort(-(unit @ book.centroids.T), axis=1, kind="stable")[:, :probes]
        flat, row = near.ravel(), np.repeat(np.arange(len(ids)), near.shape[1])
        cells = np.unique(flat)
        wanted = {int(c): row[flat == c] for c in cells}
        here = lists.where(F.col("cell").isin([int(c) for c in cells])) if len(cells) <= LISTED else lists
        rough = here.select("cell", "memory_key", "code", "lost", "content_embedding").mapInArrow(_scored(book, unit, ids, wanted, k, keep), "query_id long, cell long, memory_key long, rough double")
        best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "memory_key")
        rough = rough.distinct().withColumn("r", F.row_number().over(best)).where(f"r <= {keep}").drop("r")
        found = here.select("cell", "memory_key", "content_embedding").join(F.broadcast(rough), ["cell", "memory_key"])  # keep rows a query of a block
        found = found.join(F.broadcast(asked.select("query_id", "content_vec")), "query_id")
        score = cosine(F.col("content_embedding"), F.col("content_vec"))
        order = Window.partitionBy("query_id").orderBy(F.desc("vector"), "memory_key")
        return found.select("query_id", "memory_key", score.alias("vector")).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")

    return _by_block(queries, block, BLOCK)


def pairs_read(lists: DataFrame, book: Codebook, queries: DataFrame, probes: int = 8) -> DataFrame:
    """One row: the pairs of queries and memories whose codes a search reads, and all pairs."""
    sizes = lists.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    read = probed(book, queries, probes).join(sizes, "cell").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("pairs_read"))
    every = sizes.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n")).crossJoin(queries.agg(F.count(F.lit(1)).alias("asked")))
    return read.crossJoin(every.select((F.col("n") * F.col("asked")).alias("all_pairs")))  # one row each
