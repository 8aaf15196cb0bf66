import datetime
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from convorecall.operators import curate, embed
from convorecall.plans.build import build, memories_of
from convorecall.sources import conversations as C
from convorecall.sources import store


def chat(n, start=1704067200):
    return {"meta": {"name": "n", "type": "group"}, "members": [], "messages": [{"sender": "s", "accountName": f"A{i % 2}", "timestamp": start + 60 * i, "type": 0, "content": f"hello {i}"} for i in range(n)]}


def test_files_to_store(spark, tmp_path):
    root = tmp_path / "chats"
    for path, body in (("a/a.json", chat(5)), ("b/c/c.json", chat(4)), ("a/d/d.json", chat(9)), (".x/.x.json", chat(3)), ("e/other.json", chat(3))):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(json.dumps(body))
    (root / "bad").mkdir()
    (root / "bad/bad.json").write_text("{ no json")
    paths = [r.path for r in C.discover(spark, str(root)).collect()]
    assert sorted(p.split("/chats/")[1] for p in paths) == ["a/a.json", "b/c/c.json", "bad/bad.json"]
    read = C.read_conversations(spark, paths).cache()
    assert C.bad_files(read).first()[0] == 1
    messages = C.messages_of(C.valid(read)).cache()
    assert messages.count() == 9 and messages.where("sender_name = 'A0'").count() == 5
    build(messages, str(tmp_path / "store"), dim=16)
    saved = store.load(spark, str(tmp_path / "store/memories"))
    assert saved.count() == 2 and {len(r.content_embedding) for r in saved.collect()} == {16}
    fresh = memories_of(messages.where("conversation_key = 'a'").withColumn("content", F.lit("new text")), dim=16)
    store.refresh(spark, str(tmp_path / "store/memories"), fresh)
    texts = {r.conversation_key: r.content_text for r in store.load(spark, str(tmp_path / "store/memories")).collect()}
    assert "new text" in texts["a"] and "hello" in texts["c"]
    assert store.load_index(spark, str(tmp_path / "store/index"))["postings"].count() > 0
    assert embed.store_stats(store.load(spark, str(tmp_path / "store/memories"))).first().memories == 2


def test_injected_embedder(spark):
    df = spark.createDataFrame([(1, "aa", "b"), (2, "boom", "b"), (3, None, "c")], "id int, content_text string, context_text string")

    def embedder(texts):
        if "boom" in texts:
            raise RuntimeError
        return np.array([[len(t), 1.0] for t in texts])

    rows = {r.id: r for r in embed.embed(df, embedder, 2, texts=1).collect()}
    assert rows[1].content_embedding == [2.0, 1.0] and rows[2].content_embedding == [0.0, 0.0] and rows[3].content_embedding == [0.0, 1.0]
    assert embed.run_summary(embed.embed(df, embedder, 2, texts=1)).first().failed == 1


def test_tabular_and_profile(spark):
    df = spark.createDataFrame([("hi", datetime.datetime(2024, 1, 2), "a"), ("yo", datetime.datetime(2024, 1, 1), "b")], "content string, timestamp timestamp, sender_name string")
    messages = C.tabular_messages(df)
    assert [r.content for r in messages.orderBy("seq").collect()] == ["yo", "hi"]
    everyone = spark.createDataFrame([("default", "default", "private"), ("empty", "empty", "group")], "conversation_key string, conversation_name string, conversation_type string")
    rows = {r.conversation_key: r for r in curate.profile(messages, curate.as_of(2024, 1, 12), everyone).collect()}
    assert rows["default"].days_since_last == 10 and rows["empty"].message_count == 0 and rows["empty"].days_since_last > 8000
    assert curate.summary(curate.profile(messages.limit(0), curate.as_of(2024, 1, 1)), everyone).first().removed_percent == 0.0


def test_tree_is_written_found_and_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert C.read_tree(spark, root).count() == 0
    body = '{"meta": {"name": "n", "type": "group"}, "messages": [{"sender": "a", "timestamp": 1, "content": "hi"}]}'
    paths = ["a b/a b.json", "up/low/low.json", "a b/in/in.json", ".dot/.dot.json", "x/other.json"]
    rows = [*[(p, body) for p in paths], ("cut/cut.json", body[:50]), (None, body)]
    assert C.write_files(spark.createDataFrame(rows, "path string, body string"), root) == 6
    read = C.read_tree(spark, root).cache()
    assert sorted(r.conversation_key for r in read.collect()) == ["a b", "cut", "low"]
    assert C.bad_files(read).first().asDict() == {"bad_files": 1, "read_files": 2}
    assert sorted((r.conversation_key, r.content) for r in C.messages_of(C.valid(read)).collect()) == [("a b", "hi"), ("low", "hi")]


def test_requests_leave_a_task_together(spark):
    texts = ["a" * 10, None, "b" * 20, "c" * 5] * 700
    rows = [(f"g{i // 900}", i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, i long, content_text string, context_text string").coalesce(1)
    made = embed.embed(df, lambda t: np.full((len(t), 1), len(t)), 1, "g", ["i"], 40, 3)
    want, request, key, total = {}, [], None, 0
    for g, i, t, x in rows:
        n = int(len(t or "") * 1.5) + int(len(x) * 1.5)
        if request and (g != key or total + n > 40 or len(request) >= 3):
            want |= dict.fromkeys(request, len(request))
            request, total = [], 0
        key, total = g, total + n
        request.append(i)
    want |= dict.fromkeys(request, len(request))
    got = made.collect()
    assert {r.i: r.content_embedding[0] for r in got} == want == {r.i: r.context_embedding[0] for r in got}
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["g", "i", "content_text", "context_text"])
    sent = list(embed._requests(lambda t: np.full((len(t), 1), len(t)), 1, "g", 40, 3, (OSError,))(iter([batch])))
    assert sum(b.num_rows for b in sent) == len(rows) and len(sent) < 10  # not a batch a request
