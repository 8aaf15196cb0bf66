import hashlib
import random

from convorecall.llm import suffix_dedup


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "the", "é", "😀x", "schön", "lorem", "ipsum", "dolor"] + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(12, 60)) for _ in range(4)] + ["z" * 130]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 500), (4, "x" * 100), (5, "x" * 101)]
    for i in range(6, 60):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(100 - k, rows[20][1]) for k in range(5)]
    rng.shuffle(rows)
    return rows


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).drop("kept").collect()}


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)
    monkeypatch.setattr(suffix_dedup, "SMALL_ROWS", 0)
    rows = corpus(2)
    assert result(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    """Repeats have their document's result; texts of one id are told apart; clashing columns are not read."""
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, b + a[:150]), (3, a[50:300]), (3, a[50:300]), (3, a[50:300]), (4, None), (4, None), (4, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as copy", "'x' as runs", "2 as size", "3 as row", "4 as g").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).drop("kept").collect())
    assert len(got) == len(rows) - 1
    assert [r[:4] for r in got if r[0] == 1] == [(1, 400, 0, 0)] * 2
    assert [r[:4] for r in got if r[0] == 3] == [(3, 250, 250, 1)] * 3
    assert [r[:4] for r in got if r[0] == 4] == [(4, 0, 0, 0)] * 3
    # of b and b + part of a, whichever comes first stays whole but for a's part
    assert sorted(r[1:4] for r in got if r[0] == 2) in ([(400, 0, 0), (550, 550, 1)], [(400, 400, 1), (550, 150, 1)], sorted([(400, 0, 0), (550, 550, 2)]))


def test_larger_places(monkeypatch):
    """The same anchors whether places take 28 bits of a hash or more."""
    import numpy as np

    data = np.frombuffer(" ".join(t or "" for _, t in corpus(7)).encode(), np.uint8)
    ends = np.array([0, len(data) // 3, len(data)])
    few = suffix_dedup.anchors(data, ends)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 31)
    assert all((x == y).all() for x, y in zip(few, suffix_dedup.anchors(data, ends)))


def test_empty(spark):
    assert result(spark, []) == {}
