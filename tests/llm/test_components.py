import random

from convorecall.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (5, 5), (300, 301), (301, 302), (302, 300)] + [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(df.limit(0)).count() == 0
