import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from convorecall.llm import conversations as C

SPACE = "[^\x20\x09-\x0d]"


def planted(rows):
    """{conv_id: rows after damage, in order}"""
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c in out:
        out[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def brute(rows):
    """Every sequence of edits worth a try, in full."""
    seen, faults, n = set(), [], [0, 0, 0]
    for turn, role, text in rows:
        found = re.findall(SPACE, text)
        fault = 0 if not found else 1 if (role, text) in seen else 2 if found[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault is not None:
            n[fault] += 1

    def tail(roles):
        return "u" if roles[-1:] in ("", "s", "a") else "a"

    states = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for (k, roles), (cost, audit, lines) in list(states.items()):
                role = {"u": "user", "a": "assistant"}[tail(roles)]
                new = (cost + 2, audit + "I", (*lines, role + ":"))
                at = (i, (roles + role[0])[:1] + (roles + role[0])[-1:])
                if at not in states or new[:2] < states[at][:2]:
                    states[at] = new
        if i == len(rows):
            break
        following = {}
        _, role, text = rows[i]
        for (k, roles), (cost, audit, lines) in states.items():
            options = [(3, "D", roles, lines)]
            if faults[i] not in (0, 1):
                name = {"u": "user", "a": "assistant"}[tail(roles)]
                options.append((2 + (faults[i] == 2), "R", roles + name[0], (*lines, f"{name}:{text}")))
                if role[:1] == tail(roles) or role[:1] == "s" and not roles:
                    options.append(((faults[i] == 2), "K", roles + role[0], (*lines, f"{role}:{text}")))
            for more, edit, to, out in options:
                new, at = (cost + more, audit + edit, out), (i + 1, to[:1] + to[-1:])
                if at not in following or new[:2] < following[at][:2]:
                    following[at] = new
        states = following
    cost, audit, lines = min(v for (i, roles), v in states.items() if roles == "" or roles[-1] == "a")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n, most):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    texts = ["Hi.", "No!", "what", "", " \n", "a.b", None, "é?", "ok. \t"]
    out = []
    for c in range(n):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            out.append((c, None if rng.random() < 0.04 else turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit("x"), "nth": F.lit(3)})
    return {r.conv_id: tuple(r)[1:] for r in C.repaired(C.damaged(df)).collect()}


def test_equals_brute_force(spark):
    rows = made(1, 300, 9) + [(None, 1, "user", "x."), (None, None, None, None), (2**60, 2**60, "user", "x."), (2**60, 2**60 + 2, "assistant", "y")]
    random.Random(0).shuffle(rows)
    want = {c: brute(own) for c, own in planted(rows).items()}
    assert run(spark, rows) == want
    assert len({v[6] for v in want.values()}) > 50


def test_long_conversation_over_batches_and_file(spark, monkeypatch):
    rows = [(7, t, *x[2:]) for t, x in enumerate(made(2, 1, 1) + made(3, 900, 9))]
    want = brute(planted(rows)[7])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert run(spark, rows) == {7: want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(C, "IN_MEMORY", 16)
    automaton = C.Automaton()
    one, seen = C.Repair((7, False), automaton), set()
    for turn, role, text in planted(rows)[7]:
        found = re.findall(SPACE, text)
        one.add(turn, role, text, C.BLANK if not found else C.DUPLICATE if (role, text) in seen else C.CUT if found[-1] not in ".!?" else 0)
        seen.add((role, text))
    assert one.steps._file and one.result()[2:] == want
    assert len(automaton.steps) < 2000


def test_nothing_left_and_empty(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert run(spark, [(1, lost, "user", "x.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}
