import datetime
import random

from pyspark.sql import functions as F

from convorecall.operators import sessions as S

START = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    """Rows of (conversation, seconds, content, type)."""
    out = [(c, c, "private", i, "a", "A(x)", START + datetime.timedelta(seconds=s), t, k) for i, (c, s, t, k) in enumerate(rows)]
    return spark.createDataFrame(out, "conversation_key string, conversation_name string, conversation_type string, seq long, sender string, sender_name string, ts timestamp, content string, msg_type int")


def steady(n, start=0):
    return [("c", start + 60 * i, "hi", 0) for i in range(n)]


def sizes(spark, rows, **how):
    return [r.message_count for r in S.main_sessions(frame(spark, rows), **how).orderBy("conversation_key", "batch").collect()]


def test_micro(spark):
    far = 100_000
    assert sizes(spark, steady(2) + steady(3, far)) == [5]
    assert sizes(spark, steady(3) + steady(2, far)) == [3]
    assert sizes(spark, steady(45)) == [20, 20, 5]
    assert sizes(spark, steady(41) + steady(2, far)) == [20, 20, 3]
    assert sizes(spark, [("c", 1800 * i, "x", 0) for i in range(4)]) == [4]
    assert sizes(spark, [("c", 0, "x", 0), ("c", 1700, " 　", 0), ("c", 1750, "y", 1), ("c", 1700, "x", 0), ("c", 1701, "x", 0), ("c", 9999, None, 0)]) == [3]
    assert sizes(spark, []) == []


def fold(times, gap, least, most):
    out, now = [], []
    for t in times:
        if now and len(now) >= least and (t - now[-1] > gap or len(now) >= most):
            out.append(now)
            now = []
        now.append(t)
    if len(now) >= least:
        out.append(now)
    return [len(b) for b in out]


def test_equals_a_fold(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for c in range(40):
        t, times = 0, []
        for _ in range(rng.randint(0, 70)):
            t += rng.choice([10, 10, 10, 5000, -5])
            times.append(t)
        rows += [(f"c{c}", t, "x", 0) for t in times]
        want[f"c{c}"] = times
    df = frame(spark, rows)
    for least, most in ((3, 20), (2, 5), (4, 4), (1, 3), (5, 2)):
        got: dict = {}
        for r in S.main_sessions(df, 1800, least, most).orderBy("conversation_key", "batch").collect():
            got.setdefault(r.conversation_key, []).append(r.message_count)
        assert got == {c: f for c, t in want.items() if (f := fold(t, 1800, least, most))}


def test_overlap(spark):
    near, far = steady(3) + steady(4, 120 + 7200), steady(3) + steady(4, 120 + 7201)
    assert [r.message_count for r in S.overlap_sessions(S.main_sessions(frame(spark, near))).collect()] == [7]
    assert S.overlap_sessions(S.main_sessions(frame(spark, far))).count() == 0


def test_enriched(spark):
    rows = [("c", 0, "x" * 200, 0), ("c", 1, "y" * 201, 0), ("c", 2, "z", 0)]
    row = S.enriched(S.sessions(frame(spark, rows))).first()
    assert row.content_text == "A: " + "x" * 200 + "\nA: " + "y" * 200 + "...\nA: z"
    assert row.context_text == "2024年1月1日上午 参与者：A(x)"
    assert row.session_id == spark.range(1).select(F.md5(F.lit("main_1704067200.0_1704067202.0"))).first()[0]


def test_one_conversation_with_most_messages(spark):
    """Nine in ten messages are one conversation's: the batches are those of a fold, and no task has more than a few chunks."""
    rng = random.Random(3)
    rows, times, t = [], {"hot": [], "c1": [], "c2": []}, 0
    for i in range(6000):
        t += rng.choice([10, 10, 10, 10, 5000, -5])
        name = "hot" if i % 10 else rng.choice(["c1", "c2"])
        rows.append((name, t, "x", 0))
        times[name].append(t)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("48", "false", "-1")):
        spark.conf.set(k, v)
    try:
        cut = S.batches(frame(spark, rows), 1800, 3, 20).withColumn("task", F.spark_partition_id())
        cut.cache()
        most = cut.groupBy("task").count().agg(F.max("count")).first()[0]
        got = {}
        for r in cut.groupBy("conversation_key", "batch").agg(F.count("*").alias("n")).orderBy("conversation_key", "batch").collect():
            got.setdefault(r.conversation_key, []).append(r.n)
        cut.unpersist()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert most < 0.2 * len(rows)
    for name, own in times.items():
        assert [n for n in got[name] if n >= 3] == fold(own, 1800, 3, 20)
