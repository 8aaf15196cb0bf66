import math
import random

import numpy as np
import pytest

from convorecall.functions import text as T
from convorecall.operators import evaluate, search
from convorecall.plans import recall as R


def memories(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"c{i % 4}", [f"p{i % 3}"], float(i * 3600), " ".join(rng.choices(words, k=rng.randint(1, 20))), [rng.gauss(0, 1) for _ in range(8)], [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    return spark.createDataFrame(rows, "memory_key long, conversation_name string, participants array<string>, start_timestamp double, content_text string, content_embedding array<float>, context_embedding array<float>")


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, 你好吗 a1 好 x你",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens(df.t)).collect()] == [["hello", "你好", "好吗", "a1", "好", "x", "你"], [], []]


def test_bm25(spark):
    m = memories(spark)
    docs = {r.memory_key: r.content_text.split() for r in m.collect()}
    queries = spark.createDataFrame([(1, "w1 w2 w1"), (2, "absent"), (3, None)], "query_id long, query_text string")
    got = {(r.query_id, r.memory_key): r for r in search.bm25(search.build_index(m), queries).collect()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    want = {}
    for k, d in docs.items():
        if {"w1", "w2"} & set(d):
            want[k] = sum((raw[w] if raw[w] >= 0 else 0.25 * mean) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in ("w1", "w2", "w1"))
    assert {k for q, k in got} == set(want) and {q for q, _ in got} == {1}
    top = max(want.values())
    for k, v in want.items():
        assert math.isclose(got[1, k].bm25, v, rel_tol=1e-9) and math.isclose(got[1, k].bm25_norm, v / top, rel_tol=1e-9)


def test_pruned_equals_dense(spark):
    m = memories(spark)
    q = spark.createDataFrame(
        [
            (1, "w1 w2", [1.0] * 8, None, None, None, None),
            (2, "none", [0.0] * 8, [1.0] * 8, None, None, None),
            (3, "w3", [0.5, -1.0] * 4, [1.0] * 8, 3600.0, 90000.0, ["p1"]),
            (4, "w4", [1.0] * 8, None, None, None, []),
        ],
        "query_id long, query_text string, content_vec array<float>, context_vec array<float>, t_start double, t_end double, participants array<string>",
    )
    index = search.build_index(m)
    rows = {}
    for method in ("dense", "pruned"):
        found = search.hybrid_search(m, index, q, 5, method=method).orderBy("query_id", "rank").collect()
        rows[method] = [(r.query_id, r.rank, r.memory_key, round(r.score, 9)) for r in found]
    assert rows["dense"] == rows["pruned"]
    assert {r[0] for r in rows["dense"]} == {1, 2, 3}  # an empty list of participants matches nothing
    assert all(r[2] % 3 == 1 and 1 <= r[2] <= 25 for r in rows["dense"] if r[0] == 3)


def test_dense_sends_no_pairs(spark, monkeypatch):
    """Pairs are scored and weighed in tasks: no join makes them on the JVM, and a task sends its best only, with copies in the order of their keys."""
    monkeypatch.setattr(search, "CELLS", 12)
    one, two = [1.0, 0.5] + [0.0] * 6, [0.0, 1.0] + [1.0] * 6
    rows = [(i, 0.0, ["p"], "a b" if i % 2 else f"b x{i}", one if i % 2 else two, one) for i in range(90)] + [(90, None, None, "a", None, one)]
    m = spark.createDataFrame(rows, "memory_key long, start_timestamp double, participants array<string>, content_text string, content_embedding array<float>, context_embedding array<float>").repartition(3)
    q = spark.createDataFrame([(1, "a", one, one), (2, None, two, None), (3, "b b", one, two)], "query_id long, query_text string, content_vec array<float>, context_vec array<float>")
    found = search.hybrid_search(m, search.build_index(m), q, 4, method="dense")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join" not in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.memory_key)
    assert got == {1: [1, 3, 5, 7], 2: [0, 2, 4, 6], 3: [1, 3, 5, 7]}


def test_lsh_is_not_joined(spark, monkeypatch):
    """The same rows as by the definition: the best of the pairs that share a bucket; no join of candidates, whatever the blocks of queries."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(20)] + [(320, None), (321, [0.0] * 8)]
    m = spark.createDataFrame(rows, "memory_key long, content_embedding array<float>").repartition(3)
    q = m.where("memory_key % 50 = 0 or memory_key > 318").selectExpr("memory_key query_id", "content_embedding content_vec")
    planes = np.random.default_rng(1).normal(size=(3, 4, 8))
    unit = {i: np.array(v or [0.0] * 8) / (np.linalg.norm(v or [0.0] * 8) + 1e-8) for i, v in rows}
    side = {i: planes @ v for i, v in unit.items()}
    own = {i: [int(((s > 0) << np.arange(4)).sum()) for s in x] for i, x in side.items()}
    want = set()
    for i in [x.query_id for x in q.collect()]:
        probe = [{b, b ^ (1 << int(np.abs(s).argmin()))} for b, s in zip(own[i], side[i])]
        met = [j for j in own if any(b in p for b, p in zip(own[j], probe))]
        scored = sorted(met, key=lambda j: (i == 320 or j == 320, -round(float(unit[i] @ unit[j]), 9) if 320 not in (i, j) else 0.0, j))
        want |= {(i, j) for j in scored[:5]}
    for most in (4_000, 3):
        monkeypatch.setattr(search, "PRODUCT_QUERIES", most)
        found = search.lsh_search(m, q, 5, tables=3, bits=4, probes=1, exact_below=0)
        assert {(r.query_id, r.memory_key) for r in found.collect()} == want


def test_lsh_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    m = spark.createDataFrame(rows, "memory_key long, content_embedding array<float>")
    q = m.where("memory_key % 20 = 0").selectExpr("memory_key query_id", "content_embedding content_vec")
    found = {(r.query_id, r.memory_key) for r in search.lsh_search(m, q, 10).collect()}
    exact = set()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 600, 20):
        exact |= {(i, int(j)) for j in np.argsort(-(x @ x[i]))[:10]}
    assert len(found & exact) >= 0.9 * len(exact)


def test_recall(spark):
    m = memories(spark)
    q = spark.createDataFrame([(1, "w1 when", [1.0] * 8, "auto"), (2, "who w2", [1.0] * 8, "auto"), (3, "w5", [1.0] * 8, "auto")], "query_id long, query_text string, content_vec array<float>, recall_type string")
    index = search.build_index(m)
    hits = R.recall(m, index, q, 5, 0.0).collect()
    assert {(r.query_id, r.strategy) for r in hits} == {(1, "temporal"), (2, "people"), (3, "semantic")}
    assert all("时间相近" in r.recall_reason for r in hits if r.query_id == 1) and len(hits[0].memory_id) == 16
    people = spark.createDataFrame([(1, "p1", [1.0] * 8)], "query_id long, person string, content_vec array<float>")
    assert all("p1" in r.participants for r in R.by_people(m, index, people, 5, include_mentions=False, min_relevance=0.0).collect())
    with pytest.raises(ValueError):
        R.recall(m, index, q, 0)


def test_judge(spark):
    replies = [('x {"relevance_score": 7, "reasoning": "r"} y', 7.0), ("none", 5.0), ("{bad json}", 0.0), (None, 0.0)]
    df = spark.createDataFrame(replies, "reply string, want double")
    assert all(r[0] == r[1] for r in df.select(T.judged(df.reply), "want").collect())


def test_best_weight_ties(spark):
    df = spark.createDataFrame([(0.3, 1.0), (0.5, 2.0), (0.7, 2.0)], "bm25_weight double, avg_diff double")
    assert evaluate.best_weight(df, "avg_diff").first().bm25_weight == 0.5


def test_small_functions(spark):
    df = spark.createDataFrame([("hi 😀你好é", None, 0.5), (None, 7.0, 0.1)], "t string, r double, s double")
    rows = df.select(T.console_text(df.t).alias("c"), T.relevance_or_score(df.r, df.s).alias("v"), T.without_emoji(df.t).alias("e")).collect()
    assert [(r.c, r.v) for r in rows] == [("hi é", 5.0), (None, 7.0)] and rows[0].e == "hi é"  # the last range takes Han with it
    q = spark.createDataFrame([("c", "keyword", x) for x in "abc"] + [("c", "mixed", "z")], "conversation_key string, type string, text string")
    assert sorted(r.text for r in evaluate.first_of_each_type(q, 2).collect()) == ["a", "b", "z"]


def test_more_queries_than_a_block(spark, monkeypatch):
    m = memories(spark, 20).cache()
    index = {name: table.cache() for name, table in search.build_index(m).items()}
    q = m.where("memory_key < 5").selectExpr("memory_key query_id", "content_text query_text", "content_embedding content_vec", "context_embedding context_vec")

    def found():
        return [{(r.query_id, r.rank): r.memory_key for r in df.collect()} for df in (search.vector_search(m, q, 2), search.hybrid_search(m, index, q, 2, method="pruned"))]

    want = found()
    monkeypatch.setattr(search, "MAX_QUERIES", 4)
    assert found() == want and len(want[0]) == 10


def test_index_shuffles_no_postings(spark):
    rows = [(1, "b a b", ), (2, None), (3, ""), (4, "B 你好吗 c"), (5, "a " * 600 + "z")]
    index = search.build_index(spark.createDataFrame(rows, "memory_key long, content_text string").repartition(2))
    assert "Exchange" not in index["postings"]._jdf.queryExecution().toString()
    found = {(r.term, r.memory_key): (r.dl, r.tf) for r in index["postings"].collect()}
    assert found == {("b", 1): (3, 2), ("a", 1): (3, 1), ("b", 4): (4, 1), ("你好", 4): (4, 1), ("好吗", 4): (4, 1), ("c", 4): (4, 1), ("a", 5): (601, 600), ("z", 5): (601, 1)}
    ids, held = search.by_memory(index)
    assert "Exchange" not in held._jdf.queryExecution().toString()
    name = {r.id: r.term for r in ids.collect()}
    tell = lambda held: {(r.memory_key, name[t], tf) for r in held.collect() for t, tf in zip(r.terms, r.tfs)}
    assert tell(held) == {(key, term, tf) for (term, key), (_, tf) in found.items()}
    assert tell(search.by_memory({name: df for name, df in index.items() if name != "forward"})[1]) == tell(held)


def test_texts_that_hits_are_joined_to_are_not_shuffled(spark):
    hits = R.simple_search(memories(spark), search.build_index(memories(spark)), spark.createDataFrame([(1, "w1 w2", [1.0] * 8)], "query_id long, query_text string, content_vec array<float>"))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
