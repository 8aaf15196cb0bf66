import random
import re
from collections import Counter

from convorecall.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é|ü 😀 #*\n\nq\nq\nq \nQ"]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "b", "c"]) + rng.choice([" ", " ", "\n", "\x0b "]) for _ in range(rng.randint(0, 200))))
    df = spark.createDataFrame([(i, t, f"s{i % 3}", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, rate int")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    assert quality.judge(df.limit(0)).count() == 0


def test_host_rates(spark, monkeypatch):
    """Rates by each rule against the same computed here; a hot host, and the salted way give the same verdicts."""
    rng = random.Random(6)
    rows = []
    for host, short, noise in (("bad", 0.9, 0), ("good", 0.02, 0.01), ("noisy", 0.1, 0.95), (None, 0.2, 0.2)):
        for _ in range(400 if host == "good" else 40):
            n = rng.randint(1, 10) if rng.random() < short else rng.randint(20, 40)
            rows.append((len(rows), " ".join(f"w{rng.randrange(500)}" + "##$$%%" * (rng.random() < noise) for _ in range(n)), host))
    rows += [(0, "x", "small"), (0, "x", "small"), (1, "y " * 20000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = [(h or "", brute(t), t) for _, t, h in rows]
    hosts = sorted({h for h, _, _ in measured})
    failed = lambda m, t: (m[0] < 20, 100 * m[4] > 30 * m[0], 10 * m[2] > m[1], 10 * m[3] > 3 * sum(bool(x.strip()) for x in t.split("\n")))
    rates = dict.fromkeys(hosts, 0.0)
    for k in range(4):
        share = {h: [failed(m, t)[k] for g, m, t in measured if g == h] for h in hosts}
        raw = [sum(x) / len(x) for x in share.values()]
        mean = sum(raw) / len(raw)
        var = sum((x - mean) ** 2 for x in raw) / len(raw)
        w = mean * (1 - mean) / var - 1 if var > 1e-12 and mean * (1 - mean) > var else 1.0
        rates = {h: max(rates[h], (sum(share[h]) + mean * w) / (len(share[h]) + w)) for h in hosts}
    assert rates["bad"] > 0.5 and rates["noisy"] > 0.5 and rates["good"] < 0.2
    for most in (quality.SMALL_ROWS, 0):
        monkeypatch.setattr(quality, "SMALL_ROWS", most)
        got = quality.judge(df).collect()
        assert len(got) == len(rows)
        assert all(abs(r.host_rate - rates[r.host]) < 1e-9 and r.kept == (not r.base_failed and rates[r.host] <= 0.5) for r in got)
