import random

import numpy as np

from convorecall.llm import language

SYLLABLES = {"aa": ["ka", "to", "mi", "the "], "bb": ["schl", "ung", "ei", "der "], "cc": ["ción", "que", "ñ", "los "]}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(5, 200))), lang))
    return out


def test_held_out_accuracy(spark):
    model = language.fit(spark.createDataFrame(corpus(400, 1), "doc_id long, text string, lang string"))
    rows = corpus(300, 2)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 297
    assert sum(r.rejected for r in got.values()) <= 6
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    model = language.fit(spark.createDataFrame(corpus(60, 1), "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 .", "x"), (4, "ka to", "x"), (4, "q" * 300000, None)], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.predict(df, model).orderBy("doc_id").collect()]
    assert [g[1:] for g in got[:3]] == [("und", True)] * 3 and len(got) == 5
    assert language.fit(df.selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    assert language.predict(df, None).where("lang_pred <> 'und'").count() == 0
    assert language.predict(df.limit(0), model).count() == 0


def test_score_equals_brute_force(spark):
    """The average of the subwords' rows, the softmax and the temperature, one subword at a time."""
    rows = corpus(80, 1)
    model = language.train([t for _, t, _ in rows], [lang for _, _, lang in rows])
    texts = [(i, t) for i, t, _ in corpus(15, 3)] + [(50, "Ñ"), (51, "KA to " * 30000)]
    texts += texts[:2]
    got = language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    for i, text in dict(texts).items():
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total, count = np.zeros(len(model.labels)), 0
        for n in (1, 2, 3, 4):
            for k in range(len(raw) - n + 1):
                key = 0
                for b in raw[k : k + n]:
                    key = (key * 257 + b) % 2**32
                bucket = ((key * 0x9E3779B1 + n * 7919) * 0x85EBCA6B) % 2**32 >> 17
                total += model.table[bucket]
                count += 1
        z = (total / count + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        for r in got:
            if r.doc_id == i:
                assert r.lang_pred == model.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-5
                assert r.rejected == (r.score < model.least)
