import math
import os
import random
import subprocess
import sys

import zstandard

from convorecall.llm import toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD = ["vilething", "nastyword", "rudeperson", "meaninsult", "horridname", "badslur"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "to", "mi", "re", "the", "ing", "sh"]) for _ in range(rng.randint(1, 3))) for _ in range(800)]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        out.append((i, " ".join(text), toxic))
    return out


def test_held_out_quality(spark):
    train = spark.createDataFrame(corpus(500, 1), "doc_id long, text string, toxic int")
    model = toxicity.fit(train.drop("toxic"), train.select("doc_id", "toxic"))
    rows = corpus(200, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    truth = {i: t for i, _, t in rows}
    right = sum(got[i].predicted == t for i, t in truth.items())
    assert right >= 190 and all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100000), (3, "a")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(df, model).collect()} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_many_marks_are_used(spark):
    """Toxic texts hold one of 90 words that begin alike with none; the same letters occur inside ordinary words."""
    rng = random.Random(3)
    letters = "bcdfghjklmnpqrstvwxz"
    bad = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(90)]

    def rows(n, first):
        out = []
        for i in range(n):
            text = ["".join(rng.choice(["ka", "to", "mi", "re", "the", "ing"]) for _ in range(3)) for _ in range(60)]
            text += ["ka" + rng.choice(bad) for _ in range(3)]
            toxic = i % 2
            if toxic:
                text += rng.sample(bad, 4)
            rng.shuffle(text)
            out.append((first + i, " ".join(text), toxic))
        return out

    train, held = rows(1600, 0), rows(300, 5000)
    model = toxicity.train([t for _, t, k in train if k], [t for _, t, k in train if not k])
    found = [(toxicity.THRESHOLD <= model.scores(model.evidence(t)[None])[0], k) for _, t, k in held]
    assert sum(p for p, k in found if k) >= 0.95 * 150 and sum(p for p, k in found if not k) <= 0.05 * 150


def test_same_under_any_hash_seed():
    """Dictionaries and scores do not depend on the order of sets; the dictionaries are zstandard's own."""
    code = (
        "from tests.llm.test_toxicity import corpus\n"
        "from convorecall.llm import toxicity\n"
        "rows = corpus(300, 1)\n"
        "m = toxicity.train([t for _, t, k in rows if k], [t for _, t, k in rows if not k], 0.2)\n"
        "assert all(d[:4] == bytes.fromhex('37a430ec') for d in m.dictionaries)\n"
        "print(m.dictionaries, m.scores(m.evidence(rows[0][1])[None]).tolist())\n"
    )
    runs = [subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed}, cwd=ROOT, capture_output=True, text=True, timeout=120) for seed in ("1", "2")]
    assert runs[0].stdout and runs[0].stdout == runs[1].stdout, runs[0].stderr


def test_score_equals_brute_force(spark):
    """The score is the curve over the likelihood ratios of the windows' differences, taken one window at a time."""
    rows = corpus(300, 1)
    model = toxicity.train([t for _, t, k in rows if k], [t for _, t, k in rows if not k], 0.2)
    how = zstandard.ZstdCompressionParameters(compression_level=1, strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=17, hash_log=14, chain_log=14, search_log=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    packs = [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d)) for d in model.dictionaries]
    texts = [(i, t) for i, t, _ in corpus(20, 2)] + [(90, ""), (91, None), (92, "a, B. nastyword!"), (93, "vilething " * 4000)]
    texts += texts[:2]
    got = toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    for i, text in dict(texts).items():
        parts, part, size = [], [], 0
        for word in "".join(" " if c in '.,;:!?"()[]' else c for c in (text or "").lower()).split():
            part.append(word)
            size += len(word) + 1
            if size >= toxicity.WINDOW:
                parts, part, size = [*parts, part], [], 0
        ratios = []
        for words in parts + [part] * bool(part):
            raw = b"".join(toxicity._code(w) for w in words)
            steps = round((len(packs[1].compress(raw)) - len(packs[0].compress(raw))) / toxicity.STEP)
            ratios.append(model.ratios[min(max(steps, -8), 16) + 8])
        x = [sum(ratios) / 10, sum(ratios) / len(ratios) * 10, sum(sorted(ratios)[-3:]) / 5] if ratios else [0, 0, 0]
        want = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(x, model.weights)) + model.weights[3], 30), -30)))
        assert all(abs(r.score - want) < 1e-9 and r.predicted == int(want >= 0.3) for r in got if r.doc_id == i)
