import random
import re

from convorecall.llm import ngram_join
from convorecall.llm.ngram_join import jaccard_classes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=40, bases=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 160))] for _ in range(bases)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 5)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


def result(spark, rows):
    df = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark, monkeypatch):
    assert result(spark, corpus(1)) == brute(corpus(1))
    # small regions only, so that pivots, cells and differences do the work, for two rounds
    for name, value in (("LEAF", 2), ("ROUNDS", 2), ("NET", 0.1)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(3, n=90, bases=2)
    assert result(spark, rows) == brute(rows)


def test_crowd_of_near_copies(spark, monkeypatch):
    """Copies of one text with runs of words replaced, some just linked and some just not, all in one region."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(110)
            words[at : at + rng.randint(1, 4)] = [f"r{rng.randrange(40)}" for _ in range(3)]
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert 5 < len({c for _, c in want.values()}) < 60
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    assert result(spark, rows) == want


def test_repeated_rows(spark):
    rows = corpus(4, n=20)
    df = jaccard_classes(spark.createDataFrame(rows + rows[:9] + rows[:3], "doc_id long, text string"))
    found = sorted(tuple(r) for r in df.collect())
    want = brute(rows)
    assert found == sorted((i, *want[i]) for i, _ in rows + rows[:9] + rows[:3])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (7, "x " * 3000), (8, "x " * 2999)]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows] + [(None, "one two", "c", 5)], "doc_id long, text string, component_id string, n int")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()} == brute(rows)
    assert jaccard_classes(df.limit(0)).count() == 0
