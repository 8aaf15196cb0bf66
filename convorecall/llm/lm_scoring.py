"""LM scoring: counts of all training tokens, and the gated recurrent model's log-likelihood of whole documents.

Documents are dealt into chunks by a hash of their ids. A chunk sends each distinct word once, with its count, to the
word's range, however often the word occurs; the ranges add the counts up and send them back to the chunks that asked.
So a frequent word costs one entry per chunk, and nothing has to hold the whole vocabulary.

The network's words are the most frequent of all training tokens. It is warmed on a few documents; then every task trains
on from there over all the training documents that it reads, whole, and the tasks' models are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.llm import gated_lm
from convorecall.llm.scratch import drawn, texts_of, written
from convorecall.llm.textkit import Words, map_texts, string_column, text_slices

#: Documents that warm the network up, in the order of a hash of their ids, and bytes of those together; then all train it.
WARM = 300
WARM_BYTES = 2_000_000
#: Streams that a task follows side by side, and symbols that it gathers for them.
STREAMS = 256
GATHERED = STREAMS * 512
#: Models that one task adds up; their sums are added up in turn, until so many are left for the driver.
ADDERS = 16
CHUNK = 12_000_000  # bytes of text, about


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows, number of words of each)."""
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_slices(texts):
        w = Words(data, offsets)
        words.append(w.hash)
        counts.append(np.diff(w.first))
    return np.concatenate(words), np.concatenate(counts)


def _range(words: np.ndarray, ranges: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _count(ranges: int):
    def run(chunk: pa.Table) -> pa.Table:
        number = chunk.column("chunk")[0].as_py()
        words, lengths = _hashes(chunk.column("text"))
        learn = np.repeat(chunk.column("learn").to_numpy(), lengths)
        own, inverse = np.unique(words, return_inverse=True)
        counts = np.bincount(inverse, learn, len(own)).astype("<u4")
        bounds = np.searchsorted(_range(own, ranges), np.arange(ranges + 1))
        used = [k for k in range(ranges) if bounds[k] < bounds[k + 1]]
        parts = [(own[bounds[k] : bounds[k + 1]].tobytes(), counts[bounds[k] : bounds[k + 1]].tobytes()) for k in used]
        return pa.table({"chunk": pa.array([number] * len(used), pa.int64()), "range": pa.array(used, pa.int64()), "words": pa.array([p[0] for p in parts], pa.binary()), "counts": pa.array([p[1] for p in parts], pa.binary())})

    return run


def _add_up(part: pa.Table) -> pa.Table:
    """Counts of a range's words: back to the chunks that asked; as chunk -1 the sums; as chunk -2 its most frequent words."""
    raw, given = part.column("words").to_pylist(), part.column("counts").to_pylist()
    words, inverse = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
    total = np.bincount(inverse, np.frombuffer(b"".join(given), "<u4"), len(words)).astype(np.int64)
    at = np.cumsum([0] + [len(r) // 8 for r in raw])
    back = total[inverse].astype("<i8")
    top = np.lexsort((words, -total))[: gated_lm.CLASSES * gated_lm.WORDS]
    top = top[total[top] > 0]
    chunks = [*part.column("chunk").to_pylist(), -1, *[-2] * len(top)]
    answers = [back[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] + [b""] * (1 + len(top))
    rest = [0] * len(raw)
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "range": pa.array([part.column("range")[0].as_py()] * len(chunks), pa.int64()),
            "counts": pa.array(answers, pa.binary()),
            "word": pa.array([*rest, 0, *words[top].view(np.int64).tolist()], pa.int64()),
            "tokens": pa.array([*rest, int(total.sum()), *total[top].tolist()], pa.int64()),
            "types": pa.array([*rest, int((total > 0).sum()), *[0] * len(top)], pa.int64()),
        }
    )


def _train(model: gated_lm.GatedLM):
    """A task's documents -> its model's parameters times the symbols seen, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, size, seen = gated_lm.Trainer(model), [], 0, 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(string_column(batch, "text")):
                w = Words(data, offsets)
                ends = w.first[1:]
                row = np.insert(model.symbols(w.hash), ends, gated_lm.END)
                held.append(row)
                size += len(row)
                if size >= GATHERED:
                    trainer.learn(np.concatenate(held), STREAMS)
                    held, size, seen = [], 0, seen + size
        if size > 1:  # the last symbols are few: fewer streams, so that they still are some updates
            trainer.learn(np.concatenate(held), max(8, min(STREAMS, size // (gated_lm.STEPS * 64))))
            seen += size
        if seen:
            yield _sum_row(seen * _flat(model).astype(np.float64), seen)

    return run


def _flat(model: gated_lm.GatedLM) -> np.ndarray:
    return np.concatenate([getattr(model, k).ravel() for k in gated_lm.PARAMETERS])


def _sum_row(weighted: np.ndarray, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weighted.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["weighted", "seen"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for raw, n in zip(batch.column("weighted"), batch.column("seen").to_pylist()):
            own = np.frombuffer(raw.as_py(), np.float64)
            total, seen = own.copy() if total is None else total + own, seen + n
    if total is not None:
        yield _sum_row(total, seen)


def _score(model: gated_lm.GatedLM):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        words, lengths = _hashes(chunk.column("text"))
        own, inverse = np.unique(words, return_inverse=True)
        counts = np.zeros(len(own))
        if answers.num_rows:
            order = np.argsort(answers.column("range").to_numpy())
            raw = answers.column("counts").to_pylist()
            counts = np.frombuffer(b"".join(raw[i] for i in order), "<i8").astype(float)
        log = np.log10(counts + 0.1)
        symbols = model.symbols(own)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        n = len(lengths)
        rare = symbols == gated_lm.UNKNOWN
        known = np.bincount(doc, (counts > 0)[inverse], n).astype(np.int64)
        sums = np.bincount(doc, log[inverse], n)
        rare_sums = np.bincount(doc, np.where(rare, log, 0.0)[inverse], n)
        n_rare = np.bincount(doc, rare[inverse], n).astype(np.int64)
        network = model.score(symbols[inverse], lengths) / np.log(10)
        return pa.table({"doc_id": chunk.column("doc_id"), "learn": chunk.column("learn"), "n_words": pa.array(lengths), "known": pa.array(known), "sums": pa.array(sums), "rare_sums": pa.array(rare_sums), "n_rare": pa.array(n_rare), "network": pa.array(network)})

    return run


def fit(docs: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray]) -> gated_lm.GatedLM:
    """Train the network of a vocabulary on all rows of ``docs``."""
    model = gated_lm.fresh(*vocabulary)
    ids = docs.select("doc_id", F.octet_length("text").alias("size")).where("size > 0")
    sizes, left, picked = drawn(ids, WARM, 3).collect(), WARM_BYTES, []
    for r in sizes:  # a text that does not fit is left to the tasks
        if r["size"] <= left:
            picked.append((r.doc_id,))
            left -= r["size"]
    if not picked:
        return model
    rows = texts_of(docs, docs.sparkSession.createDataFrame(picked, "doc_id long").distinct()).limit(2 * WARM).collect()
    words, lengths = _hashes(pa.array([r.text for r in rows], pa.string()))
    ends = np.cumsum(lengths)
    model = gated_lm.warmed(model, [words[e - n : e] for e, n in zip(ends, lengths)])
    kinds = "weighted binary, seen long"
    models = written(map_texts(docs.select("text"), _train(model), kinds), "models")
    left = models.count()
    while left > ADDERS:
        left = -(-left // ADDERS)
        models = models.repartition(left).mapInArrow(_sum, kinds)
    sums = models.collect()  # at most ADDERS rows
    if not sums:  # no words at all
        return model
    mean = sum(np.frombuffer(r.weighted, np.float64) for r in sums) / sum(r.seen for r in sums)
    at = 0
    for k in gated_lm.PARAMETERS:
        own = getattr(model, k)
        setattr(model, k, mean[at : at + own.size].reshape(own.shape).astype(np.float32))
        at += own.size
    return model


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores of each row's whole text (null: empty).

    Tokens are lower-cased (A-Z) words and one end. ``learn`` says which rows the counts and the network learn from.
    Returns ``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score``: ``base_score`` by the smoothed counts
    alone, ``score`` by the network, both log10 probabilities of the text. With nothing to learn from, all counts are 0.
    Repeated rows give repeated rows and count as often as they come; a text of any length is one document; an empty
    table gives no rows; other columns are not read.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    chunks = max(1, -(-total // CHUNK))
    ranges = max(1, chunks // 2)
    learn = F.coalesce(learn, F.lit(False))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(chunks)).cast("long").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), learn.cast("int").alias("learn"))
    asked = dealt.groupBy("chunk").applyInArrow(_count(ranges), "chunk long, range long, words binary, counts binary")
    answers = written(asked.groupBy("range").applyInArrow(_add_up, "chunk long, range long, counts binary, word long, tokens long, types long"), "counts")
    size = gated_lm.CLASSES * gated_lm.WORDS
    top = answers.where("chunk = -2").orderBy(F.desc("tokens"), F.col("word") < 0, "word").limit(size).select("word", "tokens").collect()  # at most the network's words
    top_words, top_counts = (np.array([r[k] for r in top], np.int64) for k in (0, 1))
    model = fit(docs.where(learn), gated_lm.vocabulary_of(top_words.view(np.uint64), top_counts))
    known = model.symbols(top_words.view(np.uint64)) != gated_lm.UNKNOWN  # of these words, that is of the most frequent
    ends = dealt.agg(F.coalesce(F.sum("learn"), F.lit(0)).alias("ends"))
    stats = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types")]).crossJoin(ends)  # one row each
    stats = stats.select(
        (F.col("tokens") + F.col("ends")).alias("tokens"),
        (F.col("types") + (F.col("ends") > 0).cast("long")).alias("types"),
        (F.col("tokens") - int(top_counts[known].sum())).alias("rare_tokens"),
        (F.col("types") - int(known.sum())).alias("rare_types"),
        "ends",
    )
    schema = "doc_id long, learn int, n_words long, known long, sums double, rare_sums double, n_rare long, network double"
    scored = dealt.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "range", "counts").groupBy("chunk")).applyInArrow(_score(model), schema)
    out = scored.crossJoin(F.broadcast(stats))
    n_tokens = F.col("n_words") + 1
    base = F.col("sums") + F.log10(F.col("ends") + 0.1) - n_tokens * F.log10(F.col("tokens") + 0.1 * (F.col("types") + 1))
    full = F.col("network") + F.col("rare_sums") - F.col("n_rare") * F.log10(F.col("rare_tokens") + 0.1 * (F.col("rare_types") + 1))
    return out.select("doc_id", (F.col("learn") == 1).alias("learn"), n_tokens.alias("n_tokens"), (F.col("known") + (F.col("ends") > 0).cast("long")).alias("n_known"), F.col("tokens").alias("train_tokens"), base.alias("base_score"), full.alias("score"))
