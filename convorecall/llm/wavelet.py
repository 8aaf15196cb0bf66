"""Token-id output: one compressed wavelet matrix per shard, with random access, counting and occurrence lookup.

A shard's file holds its documents' ids and lengths and one bit-plane per bit of a token id, from the highest down.
Each plane parts the ids stably, zeros first. A plane is compressed in blocks of 4 KB; the file's directory holds the ones
before each block and where it ends, so that rank, select and access open only the blocks that they touch, one or two a plane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.llm.scratch import written
from convorecall.llm.textkit import map_texts, string_column, text_slices
from convorecall.llm.tokens import encoder

MAGIC = b"WVM2"
BITS = 16
_BLOCK = 1 << 15  # bits
_BYTES = _BLOCK // 8


class WaveletMatrix:
    """Sequence of ids below 2**16 as compressed bit-planes with a directory."""

    def __init__(self, n: int, zeros: list[int], ranks: np.ndarray, ends: np.ndarray, data: bytes):
        self.n, self.zeros, self.ranks, self.ends, self.data = n, zeros, ranks, ends, data
        self.blocks = ranks.shape[1] - 1
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        now, n = ids.astype(np.uint16), len(ids)
        blocks = -(-n // _BLOCK)
        ranks, sizes, zeros, parts = np.zeros((BITS, blocks + 1), np.int64), [], [], []
        pack = zstandard.ZstdCompressor(level=1)
        for level in range(BITS):
            bit = (now >> np.uint16(BITS - 1 - level)) & np.uint16(1) != 0
            plane = np.zeros(blocks * _BYTES, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            np.cumsum(np.bitwise_count(plane).reshape(blocks, _BYTES).sum(1), out=ranks[level, 1:])
            for k in range(blocks):
                parts.append(pack.compress(plane[k * _BYTES : (k + 1) * _BYTES].tobytes()))
                sizes.append(len(parts[-1]))
            now = np.concatenate([now[~bit], now[bit]])
            zeros.append(n - int(ranks[level, -1]))
        return cls(n, zeros, ranks, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), b"".join(parts))

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{BITS + 1}Q", self.n, *self.zeros)
        return head + self.ranks.astype("<i8").tobytes() + self.ends.astype("<i8").tobytes() + self.data

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """Reads the directory; the blocks stay compressed."""
        n, *zeros = struct.unpack_from(f"<{BITS + 1}Q", raw)
        blocks, at = -(-n // _BLOCK), 8 * (BITS + 1)
        ranks = np.frombuffer(raw, "<i8", BITS * (blocks + 1), at).reshape(BITS, blocks + 1)
        at += ranks.nbytes
        ends = np.frombuffer(raw, "<i8", BITS * blocks + 1, at)
        return cls(n, list(zeros), ranks, ends, raw[at + ends.nbytes :])

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            if len(self._open) >= 64:
                self._open.clear()
            i = level * self.blocks + k
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.ends[i] : self.ends[i + 1]], max_output_size=_BYTES)
            self._open[level, k] = np.frombuffer(raw, np.uint8)
        return self._open[level, k]

    def _bits(self, level: int) -> np.ndarray:
        plane = np.concatenate([self._block(level, k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
        return np.unpackbits(plane, count=self.n, bitorder="little").view(bool)

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // _BLOCK)[i % _BLOCK // 8]) >> i % 8 & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, _BLOCK)
        ones = int(self.ranks[level, k])
        if rest:
            block = self._block(level, k)
            ones += int(np.bitwise_count(block[: rest // 8]).sum())
            if rest % 8:
                ones += (int(block[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value: its block from the directory, its place from the block."""
        counts = self.ranks[level] if bit else np.arange(self.blocks + 1) * _BLOCK - self.ranks[level]
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little") == bit
        return block * _BLOCK + int(np.flatnonzero(bits)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(BITS):
            ones = self._rank(level, i)
            bit = self._bit(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self._rank(level, lo), self._rank(level, hi)
            if token >> (BITS - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at places lo to hi, hi excluded."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(BITS - 1, -1, -1):
            bit = token >> (BITS - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            bit, z = self._bits(level), self.zeros[level]
            before = np.empty_like(now)
            before[~bit] = now[:z]
            before[bit] = now[z:] | np.uint16(1 << (BITS - 1 - level))
            now = before
        return now


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: documents, their lengths, and their ids one after another."""
    head = zstandard.ZstdCompressor(level=1).compress(np.concatenate([doc_ids, lengths]).astype("<i8").tobytes())
    return MAGIC + struct.pack("<QQ", len(doc_ids), len(head)) + head + WaveletMatrix.build(ids).to_bytes()


def open_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, wavelet matrix) of a shard's file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a shard")
    n, size = struct.unpack_from("<QQ", raw, 4)
    head = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[20 : 20 + size], max_output_size=16 * n), "<i8")
    return head[:n], head[n:], WaveletMatrix.from_bytes(raw[20 + size :])


def _encode(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def shard(held: list) -> pa.RecordBatch:
            docs, lengths, ids = (np.concatenate(x) for x in zip(*held))
            row = {"part": part, "number": number, "first_doc": int(docs[0]), "last_doc": int(docs[-1]), "n_tokens": len(ids)}
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in row.values()), pa.array([shard_bytes(docs, lengths, ids)], pa.binary())], names=[*row, "shard"])

        tool, held, total = encoder(path, "word"), [], 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
            for lo, hi, data, offsets in text_slices(string_column(batch, "text"), min(1 << 19, 4 * shard_tokens)):
                flat, count = tool.encode(data, offsets)
                ends = np.cumsum(count)
                held.append((ids[lo:hi], count + 1, np.insert(flat, ends, end_id)))
                total += len(flat) + hi - lo
                if total >= shard_tokens:
                    yield shard(held)
                    held, total, number = [], 0, number + 1
        if held:
            yield shard(held)

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, raw in zip(batch.column("shard_start").to_pylist(), batch.column("shard")):
            docs, lengths, matrix = open_shard(raw.as_py())
            ids = matrix.ids().astype("<u4")
            ends = np.cumsum(lengths)
            crc = np.fromiter((zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())), np.int64, len(docs))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (docs, start + ends - lengths, lengths, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


_SHARD = "part long, number long, first_doc long, last_doc long, n_tokens long, shard binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = 2_000_000) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) in ascending doc_id order and write the shards' files.

    Returns the written table ``part, number, first_doc, last_doc, n_tokens, shard``; ``part`` and ``number`` give the
    shards' order. A shard is one file's bytes, kept in a binary column so that any store Spark reaches will do. Null and
    empty texts hold ``end_id`` alone; rows with a null doc_id are left out; rows of one doc_id follow each other by their
    texts; an empty table gives no shards; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(map_texts(ordered, _encode(tokenizer_path, end_id, shard_tokens), _SHARD), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards' files."""
    # starts within a part, then those of the parts, of which there are as many as partitions were written
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    starts = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("at")).join(parts, "part")
    starts = starts.select("part", "number", (F.col("before") + F.col("at")).alias("shard_start"))
    return shards.join(starts, ["part", "number"]).select("shard_start", "shard").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_tokens(shards: DataFrame, tokens: list[int], most: int = 10) -> DataFrame:
    """``part, number, token, n, places``: occurrences of each of ``tokens`` in each shard that has any, and the first ``most`` places.

    Only the blocks on the tokens' paths are opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, raw in zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), batch.column("shard")):
                matrix = open_shard(raw.as_py())[2]
                found = [(part, number, t, n, [matrix.locate(t, k) for k in range(min(n, most))]) for t in tokens if (n := matrix.count(t))]
                columns = list(zip(*found)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "number", "token", "n", "places"])

    return shards.select("part", "number", "shard").mapInArrow(run, "part long, number long, token long, n long, places array<long>")
