import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "shu") for b in ("la", "ne", "po", "ti", "gu", "x")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, text(20)), (1, text(25))]
    plain = [text(60) for _ in range(20)]
    rows = list(enumerate(plain))
    rows += [(20, plain[3]), (21, plain[3] + " extra"), (22, plain[4] + " " + items[0][1]), (23, "12 34 !"), (24, None), (25, plain[5][::-1] + " password = hunter2hunter")]
    docs = spark.createDataFrame([(i, t, "aa", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        if i in (20, 21, 22, 23, 24):  # copies, leak, no letters, null
            continue
        want[i] = len(tool.encode(re.sub(r"password = \S+", "[SECRET]", t)).ids) + 1
    assert {r.doc_id: r.length for r in got} == want


def test_edges(spark, tmp_path):
    """Empty tables, repeated rows and columns named like those of the stages."""
    items = spark.createDataFrame([(0, "one two three four five six seven eight")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start int, variant int, score string"
    docs = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and (name == "best_fit_packing" or docs.columns == [c.split()[0] for c in kind.split(", ")])
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["kala", "tone", "mipo", "reti", "shugu", "lax"]) for _ in range(50)) for _ in range(12)]
    rows = [(i, t, "aa", "s", len(t), "x", 1, 2, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, texts[0], "aa", "s", 1, "x", 1, 2, "y")], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    # rows that repeat a document go or stay with it; a row without an id has no group to be a copy in
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == sorted([(False, i) for i in range(12)] + [(False, 0), (False, 1), (True, 0)])
    assert docs.columns == [c.split()[0] for c in kind.split(", ")]
