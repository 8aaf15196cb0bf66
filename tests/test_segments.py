import glob
import os
import random

from convorecall.operators import search
from convorecall.sources import segments

KINDS = "conversation_key string, memory_key long, content_text string"


def tell(index):
    postings = sorted(tuple(r) for r in index["postings"].select("term", "memory_key", "tf", "dl").collect())
    stats = sorted((r.term, r.df, round(r.idf, 9)) for r in index["term_stats"].collect())
    size = index["corpus_stats"].first()
    return postings, stats, (size.n, round(size.avgdl or 0, 9))


def files(path, segment):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{segment}/**", recursive=True)}


def test_refreshed_equals_built_again(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12)))
    held = {f"c{c}": [(f"c{c}", 100 * c + i, text()) for i in range(8)] for c in range(12)}
    path = str(tmp_path / "index")
    segments.create(spark.createDataFrame(sum(held.values(), []), KINDS), path)
    whole = segments.segments(spark, path)[0].segment
    before = files(path, whole)
    for turn, names in enumerate((["c1"], ["c2", "new"], ["c1"])):
        fresh = [(c, 10_000 * (turn + 1) + 100 * i + j if j % 2 else 100 + j, text()) for i, c in enumerate(names) for j in range(4 + turn) if j % 2 or c == "c1"]
        held |= {c: [r for r in fresh if r[0] == c] for c in names}
        segments.refresh(spark, path, spark.createDataFrame(fresh, KINDS))
        assert tell(segments.load(spark, path)) == tell(search.build_index(spark.createDataFrame(sum(held.values(), []), KINDS)))
    found = segments.segments(spark, path)
    assert found[0].segment == whole and files(path, whole) == before  # never written again
    assert len(found) == 2 and found[1].memories == sum(len(held[c]) for c in ("c1", "c2", "new"))  # the small ones were merged
    everything = spark.createDataFrame([(c, 50_000 + i, "w1 w2") for i, c in enumerate(held) for _ in range(1)], KINDS)
    segments.refresh(spark, path, everything)
    assert tell(segments.load(spark, path)) == tell(search.build_index(everything))
    q = spark.createDataFrame([(1, "w1")], "query_id long, query_text string")
    assert search.bm25(segments.load(spark, path), q).count() == len(held)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.create(spark.createDataFrame([], KINDS), path)
    assert segments.load(spark, path)["postings"].count() == 0
    rows = spark.createDataFrame([("a", 1, "x y")], KINDS)
    segments.refresh(spark, path, rows)
    assert tell(segments.load(spark, path)) == tell(search.build_index(rows))
