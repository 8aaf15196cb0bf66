import hashlib
import random
import zlib

from pyspark.sql import functions as F

from convorecall.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text=None):
    values = [row[0], row[3], row[2], row[4], row[1] if text is None else text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and each node's siblings level by level as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, path in enumerate(paths):
            lo = at[k] // 8 * 8
            path.append((level[lo : at[k]], level[at[k] + 1 : lo + 8]))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = []
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in groups[name])
        subs.append((own, *tree([k[2] for k, _ in own])))
    root, tops = tree([s for _, s, _ in subs])
    out = []
    for (own, sub, paths), top in zip(subs, tops):
        for (key, r), path in zip(own, paths):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for before, after in path + top:
                node = h("".join(before) + node + "".join(after))
            out.append((r[0], key[2], sub, root, h("".join(x for b, a in path + top for x in b + a)), node, node == root))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"tree": F.lit(1), "pos": F.lit(2)})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.proofs(df, {"text": lowered}, tampered).collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "", "é", "zz"]
    return [(i, rng.choice(["Some Text É", "plain", "", None, "X" * 5000, "ü Ä"]), rng.choice(langs), rng.choice(["a", None]), rng.choice([5, None])) for i in range(n)]


def test_equals_brute_force(spark):
    for rows in (made(1300, 1), made(9, 2), [(1, "A", "en", None, None)], [(None, None, None, None, None), (5, "B", None, "s", 1)]):
        random.Random(0).shuffle(rows)
        assert run(spark, rows) == sorted(brute(rows), key=str)


def test_repeated_rows_and_keys(spark):
    rows = made(40, 3) + [(7, "Same", "en", "s", 4)] * 600 + [(7, "other", "en", "s", 5)] * 3 + [(None, "q", "en", "s", 4)] * 2
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_one_frontier_agrees(spark):
    rows = made(700, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = df.select(F.lit("x").alias("tree"), "doc_id", F.unhex(merkle.leaf_hash()).alias("digest"))
    numbered = merkle.written(merkle._numbered(leaves, ["doc_id", "digest"]))
    nodes = sorted(numbered.collect(), key=lambda r: r.pos)
    assert [r.pos for r in nodes] == list(range(700)) and {r.n for r in nodes} == {700}
    root, paths = tree([bytes(r.digest).hex() for r in nodes])
    for node, path in zip(nodes, paths):
        witness = bytes.fromhex("".join(x for b, a in path for x in b + a))
        assert merkle.fold(bytes(node.digest), node.pos, 700, witness).hex() == root
    frontier = merkle.Frontier(merkle.depth(700))
    for node in nodes:
        frontier.append(bytes(node.digest))
    assert frontier.close().hex() == root
    assert [bytes(w).hex() for w in frontier.witnesses] == ["".join(x for b, a in path for x in b + a) for path in paths]
