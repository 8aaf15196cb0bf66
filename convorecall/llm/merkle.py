"""Merkle manifest of a table by incremental witnesses.

Every row is a leaf, leaves are ordered inside their group, runs of eight nodes hash to their parent, and the groups'
roots form one more tree. Positions come from a range sort, and blocks of 512 consecutive nodes are dealt to tasks. A
task appends the nodes of a block one by one: each node carries a partial witness, the siblings met so far on its way
up, kept with the open subtree that it is in. When the last sibling of a run completes, the witnesses below the run are
extended by it and the run becomes one node of the level above. The roots of blocks are appended in the same way as
nodes of a smaller tree, until one block holds a whole tree; a leaf's witness is then extended by that of its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convorecall.llm.scratch import scope, small, written

ARITY = 8
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Blocks' witnesses, of at most 21 digests each, up to which they are sent to all executors.
WITNESS_ROWS = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """sha256 (hex) of the fields, each ``-`` if null, else its length in bytes, ``:`` and the value; ``changed`` replaces fields."""
    return F.sha2(F.concat(*[_encoded(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def run_hash(digests: bytes) -> bytes:
    """Digest of consecutive 32-byte digests, which are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes; a lone node is its own root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Frontier:
    """Open subtrees of one block, and the partial witnesses of the nodes under them."""

    def __init__(self, levels: int):
        self.levels = levels
        self.witnesses: list[bytearray] = []
        self._open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]

    def append(self, digest: bytes) -> None:
        self.witnesses.append(bytearray())
        self._add(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _add(self, level: int, digest: bytes, first: int, end: int) -> None:
        self._open[level].append((digest, first, end))
        if level < self.levels and len(self._open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        digests = b"".join(d for d, _, _ in run)
        for k, (_, first, end) in enumerate(run):
            others = digests[: 32 * k] + digests[32 * k + 32 :]
            for witness in self.witnesses[first:end]:
                witness += others
        self._add(level + 1, run_hash(digests), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """Complete what is open, and the block's root."""
        for level in range(self.levels):
            if self._open[level]:
                self._complete(level)
        return self._open[self.levels][0][0]


def fold(node: bytes, pos: int, n: int, witness: bytes) -> bytes:
    """The root that a node at place ``pos`` of ``n`` and its witness lead to."""
    at = 0
    while n > 1:
        own, run = pos % ARITY, min(ARITY, n - pos + pos % ARITY)
        others = witness[at : at + 32 * (run - 1)]
        node = run_hash(others[: 32 * own] + node + others[32 * own :])
        at += len(others)
        pos, n = pos // ARITY, -(-n // ARITY)
    return node


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by tree and place, with witnesses inside their blocks; a block's first row has its root."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        pos, n = (rest.column(c).to_numpy() for c in ("pos", "n"))
        digests = rest.column("digest").to_pylist()
        lo, witnesses, roots = 0, [], []
        while lo < len(pos):
            size = min(BLOCK, int(n[lo] - pos[lo]))
            if lo + size > len(pos):
                break
            frontier = Frontier(min(LEVELS, depth(int(n[lo]))))
            for digest in digests[lo : lo + size]:
                frontier.append(digest)
            roots += [frontier.close(), *[None] * (size - 1)]
            witnesses += map(bytes, frontier.witnesses)
            lo += size
        done, rest = rest.slice(0, lo), rest.slice(lo)
        yield from done.append_column("witness", pa.array(witnesses, pa.binary())).append_column("root", pa.array(roots, pa.binary())).to_batches()
    if rest is not None and len(rest):
        raise ValueError("places of a tree's nodes have gaps")


def _appended(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, pos, n, digest and more) with ``witness`` and ``root``, as a written table."""
    dealt = nodes.repartition("tree", F.expr(f"pos div {BLOCK}")).sortWithinPartitions("tree", "pos")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return written(dealt.mapInArrow(_blocks, f"{fields}, witness binary, root binary"), name)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place in their tree by ``order`` (rows equal in it in any order), and ``n``, its size.

    Rows are sorted by ranges, so neither a large tree nor a repeated key is one task's; the window has one row for each tree of a range.
    """
    keys = ["tree", *order, "_row"]
    rows = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    ranges = rows.groupBy("tree", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n")), "ranges")
    found = rows.withColumn("part", F.shiftright("at", 33)).join(small(ranges), ["tree", "part"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= WITNESS_ROWS else table


def _witnessed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered ``nodes`` with their whole ``witness`` in their tree, and each tree's ``root``."""
    levels, roots, most = [_appended(nodes, "witnesses")], [], BLOCK + 1
    while most > BLOCK:
        below = levels[-1]
        roots.append(below.where(f"root is not null and n <= {BLOCK}").select("tree", "root"))
        most = below.agg(F.max("n")).first()[0] or 0
        if most > BLOCK:
            up = below.where(f"root is not null and n > {BLOCK}")
            up = up.select("tree", F.expr(f"pos div {BLOCK}").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
            levels.append(_appended(up, "witnesses"))
    whole = levels.pop().drop("root")
    while levels:
        upper = whole.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"))
        below = levels.pop().drop("root").withColumn("block", F.expr(f"pos div {BLOCK}"))
        whole = below.join(_few(upper), ["tree", "block"], "left").withColumn("witness", F.concat("witness", F.coalesce("upper", F.lit(b"")))).drop("upper", "block")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return whole, out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        proofs, folded = [], []
        for k, digest in enumerate(c["digest"]):
            proofs.append(hashlib.sha256((c["witness"][k] + c["top_witness"][k]).hex().encode()).hexdigest())
            sub = fold(c["changed"][k] or digest, c["pos"][k], c["n"][k], c["witness"][k])
            folded.append(fold(sub, c["top_pos"][k], c["top_n"][k], c["top_witness"][k]).hex())
        hexes = [pa.array([x.hex() for x in c[name]]) for name in ("digest", "subroot", "root")]
        same = pc.equal(pa.array(folded), hexes[2])
        yield pa.RecordBatch.from_arrays([batch.column(0), *hexes, pa.array(proofs), pa.array(folded), same], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def proofs(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Merkle tree over all rows of ``docs``, each row's proof, and whether it still leads to the root.

    A row is a leaf of its ``lang`` (null is a group of its own, the first), in the order of ``doc_id`` (null first), then
    of the leaves' hashes; rows equal in both have the same leaf and differ in their proofs only. The groups' roots, by
    ``lang``, form the tree above. For the rows of ``where``, the columns ``changed`` replace fields before the proof is
    tried; all others are tried as they are. Returns one row per row: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``; of an empty table none. Other columns are not read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then bytewise
    altered = F.when(F.lit(False) if where is None else where, F.unhex(leaf_hash(**(changed or {}))))
    with scope(docs.sparkSession):
        leaves = written(docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_hash()).alias("digest"), altered.alias("changed")), "leaves")
        whole, roots = _witnessed(_numbered(leaves, ["doc_id", "digest"]))
        subroots = written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
        above, root = _witnessed(_numbered(subroots, ["name"]))
        top = above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.col("witness").alias("top_witness"))
        top = written(top.crossJoin(F.broadcast(root.select("root"))), "top")  # one root
        rows = whole.join(_few(top), "tree").select("doc_id", "digest", "changed", "pos", "n", "witness", "subroot", "top_pos", "top_n", "top_witness", "root")
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return written(rows.mapInArrow(_folded, schema), "proofs")
