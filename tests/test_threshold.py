import pyarrow as pa
import pytest

from convorecall.operators import blockmax, search, threshold
from tests.test_search import memories

KINDS = "query_id long, query_text string, content_vec array<float>, context_vec array<float>, t_start double, t_end double, participants array<string>"


def test_equals_dense(spark, monkeypatch):
    """Filters, a query without terms, one whose vectors are alike with all memories, and lists that are read to their ends."""
    monkeypatch.setattr(threshold, "FIRST", 1)
    monkeypatch.setattr(threshold, "DEEPER", 2)
    m = memories(spark, 120, 5)
    q = spark.createDataFrame(
        [
            (1, "w1 w2", [1.0] * 8, None, None, None, None),
            (2, "none", [0.0] * 8, [1.0] * 8, None, None, None),
            (3, "w3 w3 w4", [0.5, -1.0] * 4, [1.0] * 8, 3600.0, 200000.0, ["p1"]),
            (4, "w4", [1.0] * 8, None, None, None, []),
            (5, None, [0.3, 1.0, 0.0, 2.0] * 2, None, None, 90000.0, None),
            (6, "w5 w6 w7 w8 w9", [1.0, 0.0] * 4, [0.0, 1.0] * 4, None, None, None),
        ],
        KINDS,
    )
    index = search.build_index(m)
    blocks = blockmax.build(index, 8)
    tell = lambda df: [(r.query_id, r.rank, r.memory_key, round(r.score, 7), round(r.bm25_norm, 7), round(r.content_score, 7)) for r in df.orderBy("query_id", "rank").collect()]
    for weights in ((0.5, 0.5), (0.0, 1.0), (1.0, 0.0)):
        assert tell(threshold.search(m, index, blocks, q, 4, *weights)) == tell(search.hybrid_search(m, index, q, 4, *weights, method="dense"))
    rows = {r.query_id: r for r in threshold.report(m, index, blocks, q, 4).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6} and len({r.depth for r in rows.values()}) > 1
    assert any(r.touched < 120 for r in rows.values())
    with pytest.raises(ValueError):
        threshold.search(m, index, blocks, q, 4, -1.0, 1.0)


def depths(m, q, k, first, deeper):
    """By the definition, from all scores: the first depth at which the lists' last scores cannot reach the k-th best, and the rows read."""
    index = search.build_index(m)
    words, near, best = {}, {}, {}
    for r in search.bm25(index, q).collect():
        words.setdefault(r.query_id, []).append(r.bm25_norm)
    for r in search.components(m, index, q, k, method="dense").collect():
        near.setdefault(r.query_id, []).append(r.vector)
        best.setdefault(r.query_id, []).append(0.5 * r.bm25_norm + 0.5 * r.vector)
    out = {}
    for i in [r.query_id for r in q.collect()]:
        w, v, b = (sorted(x.get(i, []), reverse=True) for x in (words, near, best))
        depth = first * k
        while depth <= len(v) and b[k - 1] <= 0.5 * (w[depth - 1] if depth <= len(w) else 0.0) + 0.5 * v[depth - 1] + 1e-9:
            depth *= deeper
        out[i] = (depth, min(depth, len(w)) + min(depth, len(v)))
    return out


def test_depths_by_definition_whatever_tasks_send(spark, monkeypatch):
    """Also where tasks send too few of their scores at first, and memories that score alike lie in one task."""
    monkeypatch.setattr(threshold, "FIRST", 1)
    monkeypatch.setattr(threshold, "DEEPER", 2)
    m = memories(spark, 150, 9)
    m = m.unionByName(m.withColumn("memory_key", m.memory_key + 1000).where("memory_key % 5 = 0"))
    q = spark.createDataFrame([(i, f"w{i} w{i + 3} w{i}", [1.0, -0.5 * i] * 4, [1.0] * 8 if i % 2 else None, None, 300000.0 if i == 4 else None, ["p1"] if i == 3 else None) for i in range(1, 9)], KINDS)
    want = depths(m, q, 3, 1, 2)
    assert len({d for d, _ in want.values()}) > 2
    index = search.build_index(m)
    blocks = blockmax.build(index, 8)
    for ordered, held, queries in ((1280, 1_000_000, 4_000), (2, 40, 3)):
        monkeypatch.setattr(threshold, "ORDERED", ordered)
        monkeypatch.setattr(threshold, "HELD", held)
        monkeypatch.setattr(search, "PRODUCT_QUERIES", queries)
        assert {r.query_id: (r.depth, r.touched) for r in threshold.report(m, index, blocks, q, 3).collect()} == want


def test_lists_are_not_joined_with_postings(spark):
    """Rows come with both scores, so that neither memories nor postings are joined with what was met."""
    m = memories(spark, 60)
    index = search.build_index(m)
    q = spark.createDataFrame([(1, "w1 w2", [1.0] * 8, None, None, None, None)], KINDS)
    plan = threshold.search(m, index, blockmax.build(index, 8), q, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan and "embedding" not in plan


def test_slices():
    batch = pa.RecordBatch.from_pydict({"x": list(range(7))})
    assert [s.num_rows for s in search._slices(iter([batch, batch.slice(0, 0)]), 3)] == [3, 3, 1]
