import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convorecall.llm import crf, pii

WORDS = ["the", "oner", "Heitlich", "éau", "ñado", "and.", "of,", "at", "reads", "in", "ontion", "THAT"]


def plain(text):
    """The four patterns as they are stated."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c not in " -"]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=80))) for i in range(200)], "doc_id long, text string")
    return pii.fit(pii.labelled(docs))


TEXTS = [
    None,
    "",
    "nothing here",
    "a.b+c@x.example.com, é@ü.de x@y @z.com a@b@c.de a@-.- q@h..de %@a.b.c.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3 9999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (017) 555-7713 +49 30 1234567 +1234 +1 (2) ... x +123456789012345678 +1(555)555-55555.",
    "x" * 50_000 + " " + "7" * 50_000 + " " + "1 " * 3000 + "a@" * 2000 + "+1 " * 2000,
    "reach john dot smith (at) mail dot example dot com or 555-123-4567 now",
]


def test_base_equals_plain_patterns():
    rng = random.Random(1)
    for text in [*TEXTS[:7], *TEXTS[8:]]:
        assert pii.base_spans(text or "") == plain(text)
    for _ in range(3000):
        text = "".join(rng.choices("0123456789" * 3 + ".@-+ ()ab%_é", k=rng.randint(1, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_scan_keeps_base_and_adds(spark, field):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").withColumns({"base": F.lit(1), "_text": F.lit("x")})
    rows = pii.scan(df, field).withColumns({"all": pii.joined("spans"), "n": pii.counted("base", "ip")}).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        if r.doc_id != 7:
            assert [tuple(x) for x in r.base] == plain(text)
        spans = [tuple(x) for x in r.spans]
        assert spans == sorted([tuple(x) for x in r.base] + [tuple(x) for x in r.added])
        assert all(not (a.s < b.e and b.s < a.e) for a in r.added for b in r.base)
        assert r.all == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        if r.doc_id == 8:
            assert [text[s:e] for s, _, e in spans] == ["john dot smith (at) mail dot example dot com", "555-123-4567"]
        if r.doc_id < 3:
            assert not spans
    assert pii.scan(df.limit(0), field).count() == 0


def test_held_out_accuracy(field):
    held = pii.examples([" ".join(random.Random(i).choices(WORDS, k=80)) for i in range(1000, 1100)], 800, seed=99)
    hit = wrong = missed = 0
    for text, marks in held:
        tokens = crf.Tokens(text)
        found = set()
        for lo, hi in tokens.segments(pii.REACH):
            found |= {(s, crf.KINDS.index(k), e) for s, k, e in crf.spans(field.decode([tokens.codes(lo, hi)])[0], tokens.start[lo:hi], tokens.end[lo:hi])}
        hit, wrong, missed = hit + len(found & set(marks)), wrong + len(found - set(marks)), missed + len(set(marks) - found)
    assert hit >= 0.97 * (hit + missed) and hit >= 0.97 * (hit + wrong)


def test_segments_agree_with_whole_texts(field):
    """What is further away than ``REACH`` from any cue is outside in a decoding of the whole text too."""
    for text, _ in pii.examples([" ".join(random.Random(i).choices(WORDS, k=400)) for i in range(50)], 200, seed=5):
        text = " ".join(random.Random(len(text)).choices(WORDS, k=60)) + " " + text + " " + " ".join(random.Random(len(text) + 1).choices(WORDS, k=60))
        tokens = crf.Tokens(text)
        whole = field.decode([tokens.codes(0, len(tokens.shape))])[0]
        apart = np.zeros(len(whole), np.int64)
        for lo, hi in tokens.segments(pii.REACH):
            apart[lo:hi] = field.decode([tokens.codes(lo, hi)])[0]
        assert (whole == apart).all()


def _paths(n):
    for path in itertools.product(range(crf.LABELS), repeat=n):
        if not crf._STARTS[path[0]] and not any(crf._FORBIDDEN[a, b] for a, b in zip(path, path[1:])):
            yield path


def test_viterbi_and_expectations_equal_enumeration():
    rng = np.random.default_rng(0)
    f = crf.Field()
    f.unary = rng.normal(size=f.unary.shape).astype(np.float32)
    f.pairs = np.where(crf._FORBIDDEN, crf._NEVER, rng.normal(size=f.pairs.shape))
    parts = [rng.integers(0, crf.SLOTS, (n, crf.TEMPLATES)) + np.arange(crf.TEMPLATES) * crf.SLOTS for n in (1, 3, 4, 4, 2)]
    for codes, labels in zip(parts, f.decode(parts)):
        scores = f._scores(codes)
        total = lambda p: sum(scores[t, x] for t, x in enumerate(p)) + sum(f.pairs[a, b] for a, b in zip(p, p[1:]))
        assert tuple(labels) == max(_paths(len(codes)), key=total)
    n = 3
    own, moves = rng.random((2, n, crf.LABELS)) + 0.1, np.where(crf._FORBIDDEN, 0, rng.random(f.pairs.shape) + 0.1)
    mask = np.array([[True] * n, [True, True, False]])
    marginal, pairs = crf._expected(own, moves, mask)
    want, both = np.zeros_like(marginal), np.zeros_like(pairs)
    for k, size in enumerate((3, 2)):
        weights = {p: np.prod([own[k, t, x] for t, x in enumerate(p)]) * np.prod([moves[a, b] for a, b in zip(p, p[1:])]) for p in _paths(size)}
        for p, w in weights.items():
            for t, x in enumerate(p):
                want[k, t, x] += w / sum(weights.values())
            for a, b in zip(p, p[1:]):
                both[a, b] += w / sum(weights.values())
    assert np.allclose(marginal[mask], want[mask]) and np.allclose(pairs, both)


def test_empty_table_finds_nothing(spark):
    empty = pii.fit(pii._table(spark, []))
    tokens = crf.Tokens("call 555-123-4567")
    assert not empty.decode([tokens.codes(0, len(tokens.shape))])[0].any()
    assert pii.labelled(spark.createDataFrame([], "doc_id long, text string")).count() == pii.EXAMPLES
