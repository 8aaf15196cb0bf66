import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from convorecall.llm import gated_lm, lm_scoring


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 3000)
    rng = random.Random(2)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = [(0, None), (1, ""), (2, "Çé x\tX y"), (3, "new words only")]
    for i in range(4, 120):
        w, text = rng.randrange(40), []
        for _ in range(rng.randint(1, 90)):
            w = rng.choice(follow[w])
            text.append(f"W{w}" if rng.random() < 0.1 else f"w{w}")
        rows.append((i, " ".join(text)))
    learn = F.pmod("doc_id", F.lit(10)) != 0
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), learn).collect()}
    count = Counter(t for i, text in rows if i % 10 for t in tokens(text))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for i, text in rows:
        t, r = tokens(text), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), abs_tol=1e-6)
        assert r.score < 0
    held = [got[i] for i, _ in rows if i % 10 == 0 and i]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # it has learned what follows what


def trained(documents, updates):
    words, counts = np.unique(np.concatenate(documents), return_counts=True)
    return gated_lm.warmed(gated_lm.fresh(*gated_lm.vocabulary_of(words, counts)), documents, updates)


def test_gradients():
    """The step that a window takes agrees with differences of its loss."""
    rng = np.random.default_rng(3)
    documents = [rng.integers(1, 40, n).astype(np.uint64) for n in (9, 4, 17)]
    model = trained(documents, 5)
    for k in gated_lm.PARAMETERS:
        setattr(model, k, getattr(model, k).astype(np.float64))
    row = gated_lm.symbols_of(model, documents)
    lengths = np.array([len(d) for d in documents])
    loss = lambda: -model.score(np.concatenate([model.symbols(d) for d in documents]), lengths).sum()

    class Seen(gated_lm.Trainer):
        def _window(self, window, h):
            before = {k: v.copy() for k, v in self.par.items()}
            out = super()._window(window, h)
            for k, v in self.par.items():
                v[...] = before[k]
            return out

    trainer = Seen(model)
    trainer._window(row[None], np.zeros((1, gated_lm.WIDTH)))
    for k in gated_lm.PARAMETERS:
        value, slope = getattr(model, k), trainer.m1[k] / 0.1
        for i in np.argsort(-np.abs(slope).ravel())[:3]:
            at, old = np.unravel_index(i, value.shape), value.flat[i]
            ups = []
            for e in (1e-5, -1e-5):
                value[at] = old + e
                ups.append(loss())
            value[at] = old
            assert abs(np.clip((ups[0] - ups[1]) / 2e-5, -5, 5) - slope[at]) < 1e-3


def test_score_equals_brute_force(spark):
    """One network score, step by step, with the state carried through the whole text."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 70)))) for i in range(60)] + [(100, "w1 " * 3000), (3, "w9 w9")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = None

    def kept(docs, vocabulary, fit=lm_scoring.fit):
        nonlocal model
        model = fit(docs, vocabulary)
        return model

    lm_scoring.fit, before = kept, lm_scoring.fit
    try:
        got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_scoring.score(df, F.lit(True)).collect())
    finally:
        lm_scoring.fit = before
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w = gated_lm.WIDTH
    want = []
    for i, text in rows:
        hashes, _ = lm_scoring._hashes(pa.array([text]))
        h, total = np.zeros(w), 0.0
        for s in [*model.symbols(hashes).tolist(), gated_lm.END]:
            k = s if s < 2 else 2 + (s - 2) // gated_lm.WORDS
            z = h @ model.wc + model.bc
            total += z[k] - np.log(np.exp(z).sum())
            if s >= 2:
                y = h @ model.ww[k - 2] + model.bw[k - 2]
                total += y[(s - 2) % gated_lm.WORDS] - np.log(np.exp(y).sum())
            g, u = model.table[s], h @ model.u
            n = np.tanh(g[2 * w :] + sigmoid(g[w : 2 * w] + u[w : 2 * w]) * u[2 * w :])
            h = n + sigmoid(g[:w] + u[:w]) * (h - n)
        want.append((i, len(hashes) + 1, total / math.log(10)))  # every word is in the vocabulary
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4, abs_tol=1e-2)


def test_network_is_a_distribution():
    rng = np.random.default_rng(1)
    model = trained([rng.integers(1, 50, 200).astype(np.uint64) for _ in range(20)], 20)
    every = np.arange(gated_lm.FIRST + gated_lm.CLASSES * gated_lm.WORDS)
    h = rng.normal(0, 0.5, (1, gated_lm.WIDTH)).astype(np.float32)
    total = np.exp(model._log(np.repeat(h, len(every), 0), every)).sum()
    assert abs(total - 1) < 1e-4
    lengths = np.array([3, 0, 7])
    symbols = model.symbols(rng.integers(1, 60, 10).astype(np.uint64))
    parts = [model.score(symbols[a:b], np.array([b - a]))[0] for a, b in ((0, 3), (3, 3), (3, 10))]
    assert np.allclose(model.score(symbols, lengths), parts, atol=1e-4)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, score int")
    row = lm_scoring.score(df, F.lit(False)).first()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isclose(row.base_score, 0.0, abs_tol=1e-9)


def test_models_are_added_up_in_rounds(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    words, counts = np.unique(lm_scoring._hashes(pa.array([t for _, t in rows]))[0], return_counts=True)
    made = []
    for adders in (100, 2):
        monkeypatch.setattr(lm_scoring, "ADDERS", adders)
        made.append(lm_scoring._flat(lm_scoring.fit(docs, gated_lm.vocabulary_of(words, counts))))
    assert np.allclose(*made, atol=1e-5)
