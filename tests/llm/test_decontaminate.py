import math
import random
import re
from collections import Counter

from convorecall.llm import decontaminate


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    items = sorted(set(items), key=str)
    names = [i for i, _ in items]
    items = {k: words(t) for k, (_, t) in enumerate(items) if words(t)}
    names = dict(enumerate(names))
    sets = {i: shingles(w) if len(w) >= 5 else {tuple(w)} for i, w in items.items()}
    df = Counter(s for x in sets.values() for s in x)
    weight = lambda s: math.log(1 + len(items) / df.get(s, 1))
    out = {}
    for d, text in docs:
        w = words(text)
        for i, own in sets.items():
            n = len(items[i])
            for start in range(max(0, len(w) - min(n, 5) + 1)):
                x = shingles(w[start : start + n]) if n >= 5 else {tuple(w[start : start + n])}
                inter, union = sum(map(weight, x & own)), sum(map(weight, x | own))
                if inter >= 0.8 * union:
                    out[d, names[i]] = max(out.get((d, names[i]), 0), inter / union)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"W{i}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "a b c d"), (53, "zz"), (3, " ".join(text(20)))]
    docs = [(0, None), (1, ""), (2, "a b c d"), (900, "x a b c d zz " + "y " * 30000), (901, "a b c")]
    for d in range(3, 60):
        parts = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            item = items[rng.randrange(12)][1].lower().split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                place = rng.randrange(len(item))
                how = rng.randrange(3)
                item[place : place + (how != 1)] = ["changed"] if how < 2 else []  # changed, inserted or left out
            at = rng.randint(0, len(parts))
            parts[at:at] = item
        docs.append((d, "\n".join(parts)))
    docs += docs[5:20]  # repeated rows
    items += items[:3]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, start int, variant int")
    found = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = brute(docs, items)
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert {(2, 52), (900, 52), (900, 53)} <= got.keys()
    kept = {r.doc_id for r in decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, items).count() == 0
    assert decontaminate.find(spark.createDataFrame([(1, "a b c d e f")], docs.schema), items).count() == 0
