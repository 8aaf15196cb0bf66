"""Suffix-array dedup: every byte inside a string of 100 bytes that also starts earlier in the corpus is removed.

All suffixes of a corpus cannot be sorted in one place, and need not be. Each 100-byte string has one anchor, the
32-byte string inside it with the smallest hash; equal strings have equal anchors. Anchors that occur once rule their
strings out at once. The other strings go, with their anchor's neighbourhood, to the shard of their anchor. A shard
keeps a logarithmic family of suffix indexes: each arriving batch is sorted, merged against the levels in a scan for
strings they hold, and becomes a level; levels of equal size are merged. Suffixes are ordered by the fingerprint of
their first 100 bytes, since no other length counts, and of equal strings a level holds the earliest.

Copies that meet in one batch are settled there, so a passage in a third of all documents costs a shard one entry per
batch, not one per document. Copies of whole texts are settled before, by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convorecall.llm.scratch import SMALL_ROWS, small, written
from convorecall.llm.textkit import _RAW, _powers, mix, string_column, text_slices
from convorecall.tables import numbered

LENGTH = 100
GRAM = 32
PLACE_BITS = 28  # of an anchor's hash that hold its place, where no longer text needs more


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * power[: len(data)], out=total[1:])
    return total, inverse


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first string, last string) of each anchor: it rules the strings that start from first to last."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.view(np.uint64), none, none
    total, inverse = _sums(data)
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    place = np.uint64((1 << max(PLACE_BITS, n.bit_length())) - 1)
    low = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    size, span = 1, LENGTH - GRAM + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & place).astype(np.int64)  # of each string's anchor
    row = np.searchsorted(offsets, np.arange(len(at)), "right") - 1
    good = np.arange(len(at)) + LENGTH <= offsets[row + 1]
    start = good.copy()
    start[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
    first = np.flatnonzero(start)
    stop = good.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~good[1:]
    last = np.flatnonzero(stop)
    return row[first], gram[at[first]], first, last


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(data, offsets)[1] for _, _, data, offsets in text_slices(string_column(batch, "text"))]
        if found:
            own, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts.astype(np.int64))], names=["g", "n"])


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for lo, _, data, offsets in text_slices(string_column(batch, "text")):
            row, g, _, _ = anchors(data, offsets)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(g.view(np.int64))], names=["doc_id", "g"])


def _strings(shared: np.ndarray | None):
    """Neighbourhoods of shared anchors; of equal ones in a batch the earliest has its bytes, the others are known copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            parts, datas = [], []
            for lo, _, data, offsets in text_slices(string_column(batch, "text")):
                row, g, first, last = anchors(data, offsets)
                if shared is None:
                    lists = batch.column(batch.schema.get_field_index("keys"))
                    bounds = np.searchsorted(row, np.arange(len(offsets)))
                    keep = np.zeros(len(g), bool)
                    for r in np.unique(row):
                        a, b = bounds[r], bounds[r + 1]
                        keep[a:b] = np.isin(g[a:b], np.array(lists[int(lo + r)].as_py(), np.int64).view(np.uint64))
                elif len(shared):
                    at = np.minimum(np.searchsorted(shared, g), len(shared) - 1)
                    keep = shared[at] == g
                else:
                    keep = np.zeros(len(g), bool)
                row, g, first, last = row[keep], g[keep], first[keep], last[keep]
                if not len(g):
                    continue
                total, inverse = _sums(data)
                key = mix(mix((total[last + LENGTH] - total[first]) * inverse[first] + (last - first).astype(np.uint64)) + g)
                parts.append((key, g, ids[row + lo], first - offsets[row], last - first + 1, first, np.full(len(g), len(datas))))
                datas.append(data)
            if not parts:
                continue
            key, g, doc, at, n, first, part = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, doc, key))
            fresh = np.ones(len(order), bool)
            fresh[1:] = key[order][1:] != key[order][:-1]
            earliest = np.zeros(len(order), bool)
            earliest[order[fresh]] = True
            size = np.where(earliest, n + LENGTH - 1, 0)
            ends = np.cumsum(size)
            begin = ends - size
            raw = np.empty(int(ends[-1]), np.uint8)
            for k, data in enumerate(datas):
                mine = np.flatnonzero((part == k) & earliest)
                if len(mine):
                    lengths = size[mine]
                    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    raw[np.repeat(begin[mine], lengths) + inner] = data[np.repeat(first[mine], lengths) + inner]
            step = 20000  # rows of one batch
            for a in range(0, len(key), step):
                b = min(a + step, len(key))
                bounds = np.concatenate([begin[a:b], ends[b - 1 : b]]) - begin[a]
                text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw[begin[a] : ends[b - 1]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(g[a:b].view(np.int64)), text, pa.array(doc[a:b].astype(np.int64)), pa.array(at[a:b].astype(np.int64)), pa.array(n[a:b].astype(np.int64))], names=["g", "near", "doc_id", "at", "n"])

    return run


class IndexFamily:
    """Levels of sorted suffixes (fingerprint, document, place), each of about twice the size of the next."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add a batch; returns (documents, places) of the strings now known to have an earlier occurrence."""
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        out = [(doc[~fresh], at[~fresh])]
        key, doc, at = key[fresh], doc[fresh], at[fresh]
        for k, d, p in self.levels:  # a merge scan: both sides are sorted
            where = np.minimum(np.searchsorted(k, key), len(k) - 1)
            met = k[where] == key
            if met.any():
                w = where[met]
                later = (doc[met] > d[w]) | ((doc[met] == d[w]) & (at[met] > p[w]))
                out.append((doc[met][later], at[met][later]))
                out.append((d[w][~later], p[w][~later]))
                d[w[~later]], p[w[~later]] = doc[met][~later], at[met][~later]
                key, doc, at = key[~met], doc[~met], at[~met]
        if len(key):
            self.levels.append([key, doc.copy(), at.copy()])
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            merged = [np.concatenate(x) for x in zip(a, b)]
            order = np.argsort(merged[0], kind="stable")  # two sorted runs
            self.levels.append([x[order] for x in merged])
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _runs(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first].astype(np.int64)), pa.array(at[first].astype(np.int64)), pa.array(at[last].astype(np.int64))], names=["doc_id", "first", "last"])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = IndexFamily()
    for batch in batches:
        near = batch.column(batch.schema.get_field_index("near"))
        bounds = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
        data = np.frombuffer(near.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        n, doc, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "doc_id", "at"))
        total, inverse = _sums(data)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(bounds[:-1], n) + inner
        key = mix((total[begin + LENGTH] - total[begin]) * inverse[begin])
        doc, at = family.add(key, np.repeat(doc, n), np.repeat(at, n) + inner)
        if len(doc):
            yield _runs(doc, at)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
        ids, copy, runs = get("doc_id"), get("copy").to_pylist(), get("runs")
        rows: list[tuple] = []
        kept: list[bytes] = []
        for lo, hi, data, offsets in text_slices(string_column(batch, "text")):
            raw = data.tobytes()
            for r in range(lo, hi):
                text = raw[offsets[r - lo] : offsets[r - lo + 1]]
                left, spans, parts, end = 0, 0, [], 0
                if copy[r]:
                    spans, end = 1, len(text)
                elif runs[r].is_valid:
                    for run in sorted((x["first"], x["last"]) for x in runs[r].as_py()):
                        a, b = run[0], run[1] + LENGTH
                        if a > end or not spans:
                            parts.append(text[end:a])
                            spans += 1
                        end = max(end, b)
                parts.append(text[end:])
                rest = b"".join(parts)
                left = len(rest)
                rows.append((len(text), len(text) - left, spans, hashlib.sha256(rest).hexdigest()))
                kept.append(rest)
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"), F.octet_length(text).alias("size")]


def dedup(docs: DataFrame) -> DataFrame:
    """Remove repeated 100-byte strings from the texts' UTF-8 bytes (null: empty).

    Takes ``doc_id`` (rows with a null one are left out) and ``text``. Of equal strings the one in the smallest doc_id stays,
    and in one document the first; matches never cross documents. Repeats of a row are one document, and each has its
    result; different texts of one doc_id are documents in the order of their hashes. Returns per row ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, kept``: bytes, bytes removed, maximal removed runs, and what is left and
    its hash. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _deduplicated(docs)
    key = ["doc_id", "h1", "h2", "size"]
    hashed = docs.select("doc_id", "text", *_hashes(F.col("text")))
    rows = written(numbered(hashed.select(*key).distinct(), key, "row"), "rows")
    once = hashed.groupBy(*key).agg(F.first("text").alias("text")).join(rows, key).select(F.col("row").alias("doc_id"), "text")
    found = _deduplicated(written(once, "once")).withColumnRenamed("doc_id", "row")
    return hashed.select(*key).join(rows, key).select("doc_id", "row").join(found, "row").drop("row")


def _deduplicated(docs: DataFrame) -> DataFrame:
    """``dedup`` of documents with ids of their own."""
    long_ = docs.where(F.octet_length("text") >= LENGTH)
    hashed = written(long_.select("doc_id", *_hashes(F.col("text"))), "hashes")
    first = hashed.groupBy("h1", "h2", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(hashed.join(first, ["h1", "h2", "size"]).where("doc_id > first").select("doc_id"), "copies")
    own = long_.join(small(copies), "doc_id", "left_anti")
    shared = written(own.mapInArrow(_anchor_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "anchors")
    if shared.count() <= SMALL_ROWS:
        keys = np.sort(shared.toArrow().column("g").to_numpy().view(np.uint64))
        strings = own.mapInArrow(_strings(keys), "g long, near binary, doc_id long, at long, n long")
    else:  # too many to send to every worker: send each document its own
        keys = own.mapInArrow(_anchors_of, "doc_id long, g long").join(shared, "g", "left_semi").groupBy("doc_id").agg(F.collect_set("g").alias("keys"))
        strings = own.join(keys, "doc_id").mapInArrow(_strings(None), "g long, near binary, doc_id long, at long, n long")
    strings = written(strings, "strings")
    known = strings.where("octet_length(near) = 0").select("doc_id", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))
    found = strings.where("octet_length(near) > 0").repartition("g").mapInArrow(_shard, "doc_id long, first long, last long")
    runs = written(found.unionByName(known).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    total = runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("n")).first().n
    few = F.broadcast(runs) if total <= SMALL_ROWS // 4 else runs
    out = docs.join(small(copies).withColumn("copy", F.lit(True)), "doc_id", "left").join(few, "doc_id", "left")
    return out.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "runs").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
