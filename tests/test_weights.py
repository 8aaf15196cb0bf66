import random

import numpy as np

from convorecall.operators import evaluate, search, weights
from tests.test_search import memories


def difference(lines, w):
    score = sorted((w * b + (1 - w) * v for b, v in lines), reverse=True)
    return score[0] - (score[2] if len(score) > 2 else 0)


def test_pieces_equal_every_weight():
    rng = random.Random(4)
    for n in [1, 2, 3, 4, 7, 30, 200]:
        for digits in (1, 6):  # with ties and without
            lines = [(round(rng.random(), digits), round(rng.uniform(-1, 1), digits)) for _ in range(n)]
            found = weights.pieces(*map(np.array, zip(*lines)))
            assert found[0][0] == 0 and len(found) <= 2 * n + 2
            for w in np.linspace(0, 1, 501):
                _, a, b = [p for p in found if p[0] <= w + 1e-12][-1]
                assert abs(a + b * w - difference(lines, w)) < 1e-9


def test_curve_and_best_interval(spark):
    rng = random.Random(6)
    lines = {q: [(rng.choice([0.0, rng.random()]), rng.uniform(-1, 1)) for _ in range(rng.randint(1, 60))] for q in range(9)}
    rows = [(q, i, b, v) for q, own in lines.items() for i, (b, v) in enumerate(own)]
    parts = spark.createDataFrame(rows, "query_id long, memory_key long, bm25_norm double, vector double").repartition(5)
    curve = weights.curve(parts)
    mean = lambda w: sum(difference(own, w) for own in lines.values()) / len(lines)
    for r in curve.collect():
        assert abs(r.avg_diff - mean(r.weight)) < 1e-9
    best = weights.best_interval(curve).first()
    assert best.avg_diff >= max(mean(w) for w in np.linspace(0, 1, 2001)) - 1e-9
    assert abs(mean(best.from_weight) - best.avg_diff) < 1e-9 and 0 <= best.from_weight <= best.to_weight <= 1
    assert weights.curve(parts.limit(0)).count() == 0


def test_agrees_with_the_grid(spark):
    m = memories(spark, 50)
    q = spark.createDataFrame([(1, "w1 w2", [1.0] * 8), (2, "w3", [0.5, -1.0] * 4), (3, "none", [0.0, 1.0] * 4)], "query_id long, query_text string, content_vec array<float>")
    index, table = search.build_index(m), evaluate.weight_table(spark)
    want = {r.bm25_weight: r.avg_diff for r in evaluate.separation(evaluate.weight_grid(m, index, q, table, 5)).collect()}
    got = {r.bm25_weight: r.avg_diff for r in weights.at_weights(weights.curve(search.components(m, index, q, 5)), table).collect()}
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in want)
