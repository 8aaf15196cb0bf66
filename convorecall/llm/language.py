"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are the 1- to 4-grams of its lower-cased bytes; each is hashed to a row of the embedding table, and the rows
are averaged. For scoring, the table is multiplied by the output weights once, so that each subword costs one look-up.
Probabilities are calibrated by a temperature on documents that training did not see; a prediction is rejected when
its probability is below the level that nearly all of those documents exceed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convorecall.llm.scratch import drawn, texts_of
from convorecall.llm.textkit import map_texts, string_column, text_slices

#: Documents that training takes at most, in the order of a hash of their ids, and bytes of their texts together; a text
#: that does not fit any more is left out whole.
SAMPLE = 2000
SAMPLE_BYTES = 32_000_000
PIECE = 200  # bytes of the pieces of a training text
BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (1, 2, 3, 4)
NONE = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each subword, first subword of each row and the end), for each order."""
    low = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    wide = low.astype(np.uint32)
    key = np.zeros(len(data), np.uint32)
    for n in ORDERS:
        if len(data) < n:
            return
        key = key[: len(data) - n + 1] * np.uint32(257) + wide[n - 1 :]
        mixed = (key * np.uint32(0x9E3779B1) + np.uint32(n * 7919)) * np.uint32(0x85EBCA6B)
        # subwords that would cross into the next row point to a bucket that weighs nothing
        bucket = (mixed >> np.uint32(17)).astype(np.int32)
        if n > 1:
            for j in range(1, n):
                at = offsets[1:-1] - j
                bucket[at[(at >= 0) & (at < len(bucket))]] = BUCKETS
        yield bucket, np.minimum(offsets, len(bucket))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS + 1 by labels
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total = np.zeros((rows, len(self.labels)))
        count = np.zeros(rows)
        for bucket, bounds in _grams(data, offsets):
            for k in range(len(self.labels)):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[:, k][bucket], out=sums[1:])
                total[:, k] += sums[bounds[1:]] - sums[bounds[:-1]]
            count += np.diff(bounds)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's subwords, and the share of each."""
    data = np.frombuffer(raw, np.uint8)
    bucket = np.concatenate([b for b, _ in _grams(data, np.array([0, len(data)]))])
    counts = np.bincount(bucket)
    own = np.flatnonzero(counts)
    return own, (counts[own] / len(bucket)).astype(np.float32)


def train(texts: list[str], labels: list[str], epochs: int = 4, seed: int = 1) -> Model:
    """Fit to labelled texts; each gives its whole and, so that short texts are known too, all its pieces of 200 bytes.

    The pieces are dealt to the passes: each pass takes every whole text and its share of the pieces.
    """
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS + 1, WIDTH), np.float32)
    table[:-1] = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights = rng.normal(0, 0.1, (len(names), WIDTH)).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    held = np.arange(len(texts)) % 10 == 9
    items: list[list[tuple[bytes, int]]] = [[] for _ in range(epochs)]
    for text, label, out in zip(texts, labels, held):
        if out or not text:
            continue
        raw, y = text.encode(), names.index(label)
        for epoch in range(epochs):
            items[epoch] += [(raw, y), *((raw[k : k + PIECE], y) for k in range(epoch * PIECE, len(raw), epochs * PIECE))]
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs)
        for i in rng.permutation(len(items[epoch])):
            raw, y = items[epoch][i]
            bucket, share = _bag(raw)
            rows = table[bucket]
            mean = share @ rows
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights.T @ p
            weights -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            table[bucket] = rows - np.outer(rate * 20 * share, back)
    table[-1] = 0
    model = Model(names, (table @ weights.T).astype(np.float32), bias, 1.0, 0.0)
    seen = [(t, names.index(lang)) for t, lang, out in zip(texts, labels, held) if out and t]
    if seen:
        raw = [t.encode() for t, _ in seen]
        y = np.array([k for _, k in seen])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        z = np.log(np.maximum(model.probabilities(np.frombuffer(b"".join(raw), np.uint8), offsets), 1e-300))
        losses = []
        for t in np.geomspace(0.05, 5, 41):
            p = np.exp(z / t - (z / t).max(1, keepdims=True))
            losses.append((-np.log(np.maximum(p[np.arange(len(y)), y] / p.sum(1), 1e-12)).mean(), t))
        model.temperature = float(min(losses)[1])
        best = model.probabilities(np.frombuffer(b"".join(raw), np.uint8), offsets).max(1)
        model.least = float(min(np.quantile(best, 0.001) * 0.9, 0.5))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` documents with a text and a lang; None if there are none."""
    picked = drawn(docs.where("lang is not null and text is not null").select("doc_id", "lang", F.octet_length("text").alias("size")), sample, 5)
    left, taken = SAMPLE_BYTES, []
    for r in picked.collect():
        if r["size"] <= left:
            taken.append((r.doc_id, r.lang))
            left -= r["size"]
    if not taken:
        return None
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, lang string").dropDuplicates(["doc_id"])
    rows = texts_of(docs, taken).select("text", "lang").limit(2 * sample).collect()  # at most sample rows, if ids are unique
    return train([r.text for r in rows], [r.lang for r in rows])


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            names = batch.schema.names[:-2]
            column = string_column(batch, "_text")
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lang = np.full(batch.num_rows, NONE, object)
            score = np.zeros(batch.num_rows)
            sure = np.zeros(batch.num_rows, bool)
            if model:
                labels = np.array(model.labels, object)
                for lo, hi, data, offsets in text_slices(column):
                    p = model.probabilities(data, offsets)
                    lang[lo:hi] = labels[p.argmax(1)]
                    score[lo:hi] = p.max(1)
                    sure[lo:hi] = p.max(1) >= model.least
            lang[~letter], score[~letter], sure[~letter] = NONE, 0.0, False
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(~sure)], names=[*names, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each row.

    ``lang_pred`` is a learned label, or ``und`` (score 0, rejected) if the text is null or has no letter, or nothing
    was learned. ``rejected`` marks probabilities below the calibrated level too. Texts of any length are scored whole;
    repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), letter.alias("_letter"))
    return map_texts(df, _predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
