"""Best-fit packing: documents' token ids into sequences of a fixed capacity by bin completion.

Only the lengths of pieces matter for packing, and there are at most ``capacity`` different ones. So Spark counts the
pieces of each length, the search below runs on those counts (its size does not depend on the number of documents),
and its patterns are dealt to the pieces again by a join on length and rank. Ranks are taken within salted lengths. Pieces
of the full capacity are sequences of their own and take no part in this.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convorecall.llm.scratch import small, written
from convorecall.llm.textkit import map_texts, string_column, text_slices
from convorecall.llm.tokens import encoder

#: Steps of the branch and bound after its first solutions; where it ends, the best solution so far stands.
STEPS = 30_000
#: Up to so many pieces each sequence branches alone; of more, a filling is used as often as its pieces last.
FEW = 64
SALTS = 16
#: Pieces of one salt, about.
SALT_PIECES = 2_000_000

Counts = dict[int, int]
Solution = list[tuple[list[int], int]]


def lower_bound(counts: Counts, capacity: int) -> int:
    """Sequences that any packing needs: pieces above half are apart, and for each K the pieces of K and more fill what room those leave."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    if not len(sizes):
        return 0
    total = np.concatenate([[0], np.cumsum(n * sizes)])
    many = np.concatenate([[0], np.cumsum(n)])
    half = int(np.searchsorted(sizes, capacity // 2, "right"))
    best = -(-int(total[-1]) // capacity)
    for k in [0, *(s for s in sizes.tolist() if 2 * s <= capacity)]:
        low, high = int(np.searchsorted(sizes, k)), int(np.searchsorted(sizes, capacity - k, "right"))
        room = int(many[high] - many[half]) * capacity - int(total[high] - total[half])
        best = max(best, int(many[-1] - many[half]) + max(0, -(-(int(total[half] - total[low]) - room) // capacity)))
    return best


def fullest(room: int, counts: Counts) -> list[int]:
    """The filling of ``room`` with least waste; of those, the one of the largest pieces, which dominates the others.

    The sums that pieces up to each size can reach are kept as bits; the filling is read off them from the largest down.
    """
    if counts.get(room):
        return [room]
    sizes = sorted(s for s, c in counts.items() if s <= room and c > 0)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, left, k = reach[-1], min(counts[s], room // s), 1
        while left > 0:
            k = min(k, left)
            bits |= bits << (s * k)
            left -= k
            k *= 2
        reach.append(bits & mask)
    target, out = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        k = min(counts[s], target // s)
        while not reach[i] >> (target - k * s) & 1:
            k -= 1
        out += [s] * k
        target -= k * s
    return out


def best_fit(room: int, counts: Counts) -> list[int]:
    """The filling that takes the largest piece that goes in, again and again."""
    out = []
    for s in sorted((s for s in counts if s <= room), reverse=True):
        k = min(counts[s], room // s)
        out += [s] * k
        room -= k * s
    return out


def _greedy(counts: Counts, capacity: int, fill) -> Solution:
    """Sequences around the largest piece left, each filled by ``fill`` and used as often as its pieces last."""
    left, out = dict(counts), []
    while left:
        largest = max(left)
        filling = [largest, *fill(capacity - largest, _less(left, [largest]))]
        times = min(left[s] // filling.count(s) for s in set(filling))
        left = _less(left, filling, times)
        out.append((filling, times))
    return out


def _less(counts: Counts, filling: list[int], times: int = 1) -> Counts:
    left = dict(counts)
    for s in filling:
        left[s] -= times
    return {s: c for s, c in left.items() if c}


def _dominated(filling: list[int], room: int, counts: Counts) -> bool:
    """Whether a larger piece that is left over could take the place of none, one or two: what they fill, it fills better."""
    slack = room - sum(filling)
    spare = [c for c in counts if counts[c] > filling.count(c)]
    pairs = {sum(g) for g in combinations(filling, 2)}
    return any(g < c <= g + slack for g in {0, *filling} for c in spare) or any(g <= c <= g + slack for g in pairs for c in spare)


def _fillings(room: int, counts: Counts, waste: int, steps: list[int]) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` with at most ``waste`` left, those of the largest pieces first; ``steps`` holds those left."""
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    reach = 1
    for s in reversed(sizes):
        for _ in range(min(counts[s], room // s)):
            reach |= reach << s
    stack: list[tuple[int, int, list[int]]] = [(0, room, [])]
    while stack and steps[0] > 0:
        i, left, own = stack.pop()
        steps[0] -= 1
        window = reach >> max(left - waste, 0) & ((1 << (min(waste, left) + 1)) - 1)
        if not window:  # no sums of pieces come near enough
            continue
        if i == len(sizes) or left < sizes[-1]:
            if left <= waste and not _dominated(own, room, counts):
                yield own
            continue
        s = sizes[i]
        for k in range(min(counts[s], left // s) + 1):  # the most of the largest is tried first
            stack.append((i + 1, left - k * s, own + [s] * k))


def bin_completion(counts: Counts, capacity: int) -> Solution:
    """(lengths of one sequence, number of such sequences): every piece of ``counts`` (length -> number) in one.

    Best fit and the fullest fillings around the largest pieces give the first solutions. Unless one meets the lower
    bound, branch and bound goes on: the node's largest piece is completed by each undominated filling, and a branch is cut
    when its waste is more than a better solution could have.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    if any(s <= 0 or s > capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    bound, total = lower_bound(counts, capacity), sum(s * c for s, c in counts.items())
    size = lambda solution: sum(times for _, times in solution)
    best = _greedy(counts, capacity, best_fit)
    if size(best) > bound:
        best = min(best, _greedy(counts, capacity, fullest), key=size)
    alone, steps = sum(counts.values()) <= FEW, [STEPS]

    def completed(left: Counts, waste: int) -> Iterator[list[int]]:
        largest = max(left)
        room, spare = capacity - largest, (size(best) - 1) * capacity - total - waste
        return ([largest, *f] for f in _fillings(room, _less(left, [largest]), min(room, spare), steps)) if spare >= 0 else iter(())

    stack: list[tuple[Counts, Solution, int, Iterator[list[int]]]] = [(counts, [], 0, completed(counts, 0))] if counts else []
    while stack and steps[0] > 0 and size(best) > bound:
        steps[0] -= 1
        left, made, waste, branches = stack[-1]
        filling = next(branches, None)
        if filling is None:
            stack.pop()
            continue
        times = 1 if alone else min(left[s] // filling.count(s) for s in set(filling))
        waste += (capacity - sum(filling)) * times
        if waste > (size(best) - 1) * capacity - total:  # no better solution can waste as much
            continue
        left, made = _less(left, filling, times), [*made, (filling, times)]
        if left:
            stack.append((left, made, waste, completed(left, waste)))
        elif size(made) < size(best):
            best = made
    return best


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, "byte")
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offsets in text_slices(string_column(batch, "text"), 1 << 19):
                flat, count = tool.encode(data, offsets)
                at = np.concatenate([[0], np.cumsum(count)])
                rows: list[tuple[int, int, int, int, int]] = []
                for r in range(hi - lo):
                    own = np.append(flat[at[r] : at[r + 1]].astype("<u4"), np.uint32(end_id))
                    n = len(own)
                    begin, k = 0, 0
                    while begin < n:
                        size = capacity if begin or n % capacity == 0 else n % capacity
                        rows.append((r, k, begin, size, zlib.crc32(own[begin : begin + size].astype("<u4").tobytes())))
                        begin, k = begin + size, k + 1
                r, k, begin, size, crc = (pa.array(np.array(x, np.int64)) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(r), k.cast(pa.int32()), begin, size, crc], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack the token ids of ``docs`` (``doc_id``, ``text``) into sequences of at most ``capacity`` ids.

    A document is its text's ids and ``end_id``; a null or empty text has ``end_id`` alone. Documents of more than
    ``capacity`` ids are cut into pieces of that many, the first may be shorter. Returns per piece ``doc_id, piece,
    start, length, ids_crc32, sequence_id, offset``; the sequences of a full piece have negative numbers. Each row of ``docs`` is packed, repeated ids and nulls too; an
    empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(map_texts(docs, _pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    full = F.col("length") == capacity
    loose = pieces.where(~full)
    salts = max(SALTS, loose.count() // SALT_PIECES)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    per_salt = written(loose.groupBy("length", salt.alias("salt")).count(), "salts")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = written(per_salt.select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")), "before")
    counts: Counts = {r.length: r.n for r in per_salt.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    slots, base, taken = [], 0, dict.fromkeys(counts, 0)
    for filling, times in bin_completion(counts, capacity):
        at = 0
        for s in sorted(set(filling), reverse=True):
            each = filling.count(s)
            slots.append((s, taken[s], taken[s] + times * each, each, base, at))
            taken[s] += times * each
            at += each * s
        base += times
    spark = docs.sparkSession
    slots = spark.createDataFrame(slots, "length long, low long, high long, each long, base long, at long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = loose.withColumn("salt", salt).withColumn("own", F.row_number().over(order) - 1)
    ranked = ranked.join(small(before), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # the slots are patterns of lengths: at most capacity patterns of few pieces each, whatever the number of documents
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= low and rank < high")
    turn = F.col("rank") - F.col("low")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = placed.select(*columns, (F.col("base") + F.floor(turn / F.col("each"))).alias("sequence_id"), (F.col("at") + F.pmod(turn, F.col("each")) * F.col("length")).alias("offset"))
    alone = pieces.where(full).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)
