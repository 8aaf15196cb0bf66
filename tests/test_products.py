import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from convorecall.operators import blockmax, products, search
from convorecall.operators.products import Band, band
from convorecall.tables import written


def needed(words, vectors, keys, k):
    """Rows among the best k under some of many weights, both ends included."""
    out = set()
    for w in np.linspace(0, 1, 201):
        out |= set(np.lexsort((keys, -(w * words + (1 - w) * vectors)))[:k].tolist())
    return out


def test_band_keeps_what_any_weights_need():
    rng = np.random.default_rng(1)
    for digits in (0, 1, 6):  # with many ties and without
        words, vectors = rng.random(400).round(digits), rng.normal(size=400).round(digits)
        keys = rng.permutation(400)
        kept = band(words, vectors, keys, 3)
        assert needed(words, vectors, keys, 3) <= set(kept.tolist()) and len(kept) < 200
        held = Band(2, 3)
        for lo in range(0, 400, 50):
            own = slice(lo, lo + 50)
            held.add(np.ones((50, 2), bool), np.stack([words[own], words[own] * 0], 1), np.stack([vectors[own]] * 2, 1), keys[own], np.zeros((50, 2)))
        query, key, *_ = held.rows()
        assert {int(keys[i]) for i in needed(words, vectors, keys, 3)} <= set(key[query == 0].tolist())
        assert {int(keys[i]) for i in needed(words * 0, vectors, keys, 3)} <= set(key[query == 1].tolist())


def alike(spark, n=1200):
    """All memories share a word; every third is a copy of one text and one vector."""
    rng = np.random.default_rng(2)
    rows = [(i, 0.0, ["p"], "common w1" if i % 3 == 0 else f"common w{i % 11} w{i % 7} x{i}", ([1.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()), [1.0] * 8) for i in range(n)]
    return spark.createDataFrame(rows, "memory_key long, start_timestamp double, participants array<string>, content_text string, content_embedding array<float>, context_embedding array<float>").repartition(5)


def test_only_a_band_of_all_hits_leaves_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 400)
    m = alike(spark)
    index = search.build_index(m)
    q = spark.createDataFrame([(1, "common w3 w3", [1.0, 0.0] * 4), (2, "common w1", [1.0] * 8), (3, "none", [1.0] * 8)], "query_id long, query_text string, content_vec array<float>")
    assert search.components(m, index, q, 5).count() < 0.3 * 3 * 1200
    tell = lambda df: [(r.query_id, r.rank, r.memory_key) for r in df.orderBy("query_id", "rank").collect()]
    assert tell(search.hybrid_search(m, index, q, 5)) == tell(search.hybrid_search(m, index, q, 5, method="dense"))


def test_vectors_are_multiplied_and_copies_tie_by_key(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 400)
    m = alike(spark)
    q = spark.createDataFrame([(1, [1.0] * 8), (2, [-1.0] * 8)], "query_id long, content_vec array<float>")
    found = search.vector_search(m, q, 5)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert [r.memory_key for r in found.where("query_id = 1").orderBy("rank").collect()] == [0, 3, 6, 9, 12]
    exact = search.top(search.vector_scores(m, q), "vector", 5).where("query_id = 2").orderBy("rank")
    assert [r.memory_key for r in found.where("query_id = 2").orderBy("rank").collect()] == [r.memory_key for r in exact.collect()]
    related = search.related(m, m.where(F.col("memory_key") == 3), 4).first().related
    assert related == [0, 6, 9, 12]


def test_no_bounds_of_queries_and_ranges_are_written(spark, monkeypatch):
    m = alike(spark, 300)
    built = blockmax.build(search.build_index(m), 2)
    q = spark.createDataFrame([(i, "common w1 w2") for i in range(6)], "query_id long, query_text string")
    held = []

    def counted(df, name="table"):
        out = written(df, name)
        held.append(out.count())
        return out

    monkeypatch.setattr(blockmax, "written", counted)
    assert {r.blocks for r in blockmax.report(built, q, 5, 1).collect()} == {built["blocks"].where("term in ('common', 'w1', 'w2')").count()}
    assert held and max(held) <= 150


def test_few_entries_at_once(monkeypatch):
    """Sums in parts of a few rows are those of all rows at once."""
    rng = np.random.default_rng(4)
    words = pa.table({"query_id": np.repeat(np.arange(40), 6), "id": np.concatenate([rng.choice(300, 6, False) for _ in range(40)]), "qtf": rng.random(240)})
    asked = products.Asked(pa.table({"query_id": np.arange(40)}), words)
    terms = pa.array([rng.choice(300, n, False).tolist() for n in (30, 0, 200, 5, 0, 60)])
    impacts = pa.array([rng.random(len(x)).tolist() for x in terms.to_pylist()])
    want = asked.scores(terms, impacts)[0]
    by_hand = [[sum(t * i for q_, w, t in zip(*(words.column(c).to_pylist() for c in ("query_id", "id", "qtf"))) if q_ == q for x, i in zip(own, weight) if x == w) for q in range(40)] for own, weight in zip(terms.to_pylist(), impacts.to_pylist())]
    assert np.allclose(want, by_hand) and (asked.dense < 0).any()
    sizes = []
    monkeypatch.setattr(products, "ENTRIES", 7)
    count = np.bincount
    monkeypatch.setattr(products.np, "bincount", lambda x, *rest: sizes.append(len(x)) or count(x, *rest))
    assert np.allclose(asked.scores(terms, impacts)[0], want) and len(sizes) > 5
