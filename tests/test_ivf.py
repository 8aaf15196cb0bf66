import numpy as np
from pyspark.sql import functions as F

from convorecall.operators import ivf, search


def clustered(n, width=24, clusters=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 4
    return (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, width))).astype(np.float32)


def best(vectors, keys, query, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ (query / np.linalg.norm(query))
    return [int(keys[i]) for i in np.lexsort((keys, -score))[:k]]


def test_recall_and_share(spark):
    vectors = clustered(4000)
    keys = np.arange(len(vectors)) * 3
    m = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, vectors)], "memory_key long, content_embedding array<float>")
    book = ivf.train(m, cells=40, parts=8, words=32)
    lists = ivf.index(m, book)
    assert lists.count() == len(vectors)
    asked = m.where("memory_key % 60 = 0").select(F.col("memory_key").alias("query_id"), F.col("content_embedding").alias("content_vec"))
    found = {}
    for r in ivf.search(lists, book, asked, 10, probes=3).collect():
        found.setdefault(r.query_id, set()).add(r.memory_key)
    hit = total = 0
    for q in range(0, len(keys), 20):
        want = set(best(vectors, keys, vectors[q], 10))
        hit, total = hit + len(want & found[q * 3]), total + 10
    read = ivf.pairs_read(lists, book, asked, probes=3).first()
    assert hit >= 0.95 * total
    assert read.all_pairs == 200 * 4000 and read.pairs_read <= 0.12 * read.all_pairs


def test_all_cells_and_many_kept_is_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 10)).astype(np.float32)
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "memory_key long, content_embedding array<float>")
    book = ivf.train(m, cells=5, parts=3, words=4, rounds=2)
    asked = m.where("memory_key < 20").select(F.col("memory_key").alias("query_id"), F.col("content_embedding").alias("content_vec"))
    rows = ivf.search(ivf.index(m, book), book, asked, 5, probes=5, keep=300).orderBy("query_id", "rank").collect()
    for q in range(20):
        assert [r.memory_key for r in rows if r.query_id == q] == best(vectors, np.arange(300), vectors[q], 5)


def test_edges(spark):
    kinds = "memory_key long, content_embedding array<float>, cell string, code int"
    rows = [(1, [1.0, 0.0], "x", 1), (1, [1.0, 0.0], "x", 1), (2, None, None, None), (3, [], "", 0), (4, [0.0, 0.0], "y", 2)] + [(5 + i, [0.0, 1.0], "z", 3) for i in range(200)]
    m = spark.createDataFrame(rows, kinds)
    book = ivf.train(m, cells=4, parts=2, words=4)
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id long, content_vec array<float>")
    found = ivf.search(ivf.index(m, book), book, asked, 3, probes=4).orderBy("query_id", "rank").collect()
    assert [r.memory_key for r in found if r.query_id == 1][:2] == [1, 1]
    assert sum(r.query_id == 2 for r in found) <= 3
    empty = m.limit(0)
    nothing = ivf.train(empty, cells=4, parts=2, words=4)
    lists = ivf.index(empty, nothing)
    assert ivf.search(lists, nothing, asked, 3).count() == 0
    assert ivf.pairs_read(lists, nothing, asked).first().asDict() == {"pairs_read": 0, "all_pairs": 0}


def test_seeds_take_every_cluster():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.eye(12) * 10, 30, axis=0) + rng.normal(size=(360, 12)) * 0.1
    means = ivf._seeds(rows, 12, rng)
    assert sorted(means.argmax(1).tolist()) == list(range(12))
    assert search.MAX_QUERIES == 10_000


def test_swaps_mend_a_cluster_with_two_means():
    rng = np.random.default_rng(0)
    centres = np.eye(12) * 10
    rows = np.repeat(centres, 30, axis=0) + rng.normal(size=(360, 12))
    means = np.concatenate([centres[:10], centres[9:10] + 0.5, (centres[10:11] + centres[11:]) / 2])  # the last two clusters share one
    assert len(set(ivf._nearest(centres, ivf._settled(rows, means, 50)).tolist())) == 11
    assert len(set(ivf._nearest(centres, ivf._swapped(rows, means)).tolist())) == 12


def test_few_kept_is_exact_too(spark):
    vectors = np.random.default_rng(5).normal(size=(400, 12)).astype(np.float32)
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "memory_key long, content_embedding array<float>")
    book = ivf.train(m, cells=3, parts=2, words=2, rounds=2)
    asked = m.where("memory_key < 12").select(F.col("memory_key").alias("query_id"), F.col("content_embedding").alias("content_vec"))
    rows = ivf.search(ivf.index(m, book), book, asked, 5, probes=3, keep=5).orderBy("query_id", "rank").collect()
    for q in range(12):
        assert [r.memory_key for r in rows if r.query_id == q] == best(vectors, np.arange(400), vectors[q], 5)
