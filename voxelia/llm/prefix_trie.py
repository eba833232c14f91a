"""Trie of the prefixes that conversations share.

A conversation is a path of turns, each a symbol of 20 bytes: a digest of role and text, and the text's size.
Equal paths are counted with a map-side combine, and the different ones sorted over all partitions by range.
In this order the nodes of the trie are the intervals of common prefixes, and a stack of open nodes, cut back
to the common prefix with each next path, closes every node once its last path has passed.

A partition knows nothing of its neighbours, so the nodes on its first path and those still open behind its
last one may go on beyond it. These are set aside as they stand. Taken in order of the partitions they make
one stack again, which closes them. They are at most twice the partitions times the turns of a path, however
many conversations there are, and pass through the last task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelia.llm.common import remove, written

SYMBOL = 20
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
BATCH = 20_000


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path): the symbols of each conversation's turns, by turn, null first.

    Null roles and texts are empty. Turns of one number go by role, then by their symbol; equal ones all stay.
    Rows with a null conv_id are no conversation and are left out. Texts of any length count whole. Only the
    symbols are gathered, so a path of a million turns takes 20 MB. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    symbol = F.unhex(F.concat(F.md5(F.concat(F.md5(role), F.md5(text))), F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    turns = rows.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), symbol.alias("symbol")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["symbol"].alias("path"))


def rebuilt(own: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, path) with the first h turns taken from conversation conv_id - conv_id % every, h = crc32(conv_id) % (most + 1).

    That conversation gives all it has if it has fewer, none if it isn't there. Each id gives to at most
    every - 1 others, so the join has no heavy key.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(first, F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))).alias("path"))


NODE = {"id": pa.binary(), "parent_id": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
OPEN = NODE | {"size": pa.int64(), "part": pa.int32(), "side": pa.int32()}
SPARK = {pa.binary(): "binary", pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}


def ddl(kinds: dict) -> str:
    return ", ".join(f"{n} {SPARK[t]}" for n, t in kinds.items())


class Node:
    """An open node; the sums are those of what has closed below it, and n and least count the paths that end in it too."""

    __slots__ = ("id", "parent", "depth", "size", "n", "least", "children", "leaves", "saved", "ends", "first")

    def __init__(self, id_: bytes, parent: bytes | None, depth: int, size: int, first: bool = False):
        self.id, self.parent, self.depth, self.size, self.first = id_, parent, depth, size, first
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None

    def count(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def row(self) -> tuple:
        return self.id, self.parent, self.least, self.depth, self.n, self.children, self.leaves, self.saved, self.ends

    def close(self, above: Node | None) -> tuple:
        """The finished node, whose sums go to the one above."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        self.ends = self.ends or NO_ENDS
        if above is not None:
            above.count(self.n, self.least)
            above.children += 1
            above.leaves += self.leaves
            above.saved += self.saved
        return self.row()


def table_of(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition's sorted paths (key, n, least, ends): finished ones have no part, the others their order in part, side and depth."""
    part, stack, last, out = TaskContext.get().partitionId(), [], None, []

    def shut(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if node.first:  # its parent is on the first path too
                out.append((*node.row(), node.size, part, 0))
            else:
                out.append((*node.close(stack[-1]), node.size, None, None))

    for batch in batches:
        for key, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, depth = last is None, 0
            if first:
                stack.append(Node(ROOT, None, 0, 0, True))
            else:
                most = min(len(key), len(last))
                while (at := depth * SYMBOL) < most and key[at : at + SYMBOL] == last[at : at + SYMBOL]:
                    depth += 1
                shut(depth + 1)
            for at in range(depth * SYMBOL, len(key), SYMBOL):
                symbol = key[at : at + SYMBOL]
                stack.append(Node(hashlib.md5(stack[-1].id + symbol).digest(), stack[-1].id, len(stack), int.from_bytes(symbol[16:], "big"), first))
            stack[-1].count(n, least)
            stack[-1].ends, last = ends, key
            if len(out) >= BATCH:
                yield table_of(out, OPEN)
                out.clear()
    out += [(*node.row(), node.size, part, 0 if node.first else 1) for node in stack]
    if out:
        yield table_of(out, OPEN)


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes from the open ones of all partitions, sorted by part, side and depth."""
    stack: list[Node] = []
    out: list[tuple] = []

    def shut(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            out.append(node.close(stack[-1] if stack else None))

    for batch in batches:
        for id_, parent, least, depth, n, children, leaves, saved, ends, size, _, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(stack) <= depth or stack[depth].id != id_:
                shut(depth)
                stack.append(Node(id_, parent, depth, size))
            node = stack[depth]
            node.count(n, least)
            node.children += children
            node.leaves += leaves
            node.saved += saved
            node.ends = node.ends or ends
        if len(out) >= BATCH:
            yield table_of(out, NODE)
            out.clear()
    shut(0)
    if out:
        yield table_of(out, NODE)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, ends): for each leaf of sorted rows (leaf, conv_id), the SHA-256 of its ids, joined by commas, as a stream."""
    at, sha = None, None
    for batch in batches:
        out = []
        for leaf, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if leaf != at:
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = leaf, hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        yield table_of(out, {"leaf": pa.string(), "ends": pa.string()})
    if at is not None:
        yield table_of([(at, sha.hexdigest())], {"leaf": pa.string(), "ends": pa.string()})


def trie(members: DataFrame) -> DataFrame:
    """Nodes of the trie of members (conv_id bigint, path array<binary> of symbols as paths() makes them).

    Returns (id, parent_id, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), one row a node: id hashes its path, conv_id is its smallest member, which together with the
    depth names it as well, so its text is that of turn number depth of that member. The root has depth 0 and
    null parents. A null path counts as an empty one; without members there is no node. Members with one conv_id
    count each.

    Equal paths, however many, are one row before the sort, so the ranges have no heavy key. Their ids alone go
    to one task a path, since one hash runs over them in order; it holds no more than the hash.
    """
    spark = members.sparkSession
    key = F.unhex(F.array_join(F.transform(F.coalesce("path", F.array().cast("array<binary>")), F.hex), ""))
    flat = written(members.select("conv_id", key.alias("key")), "paths")
    ends = flat.select(F.md5("key").alias("leaf"), "conv_id").repartition("leaf").sortWithinPartitions("leaf", "conv_id").mapInArrow(hashed, "leaf string, ends string")
    once = flat.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).withColumn("leaf", F.md5("key"))
    once = written(once.join(ends, "leaf").select("key", "n", "least", "ends"), "different-paths")
    remove(spark, flat)
    found = written(once.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(swept, ddl(OPEN)), "trie-nodes")
    remove(spark, once)
    open_ = found.where("part is not null").repartition(1).sortWithinPartitions("part", "side", "depth")
    closed = written(open_.mapInArrow(stitched, ddl(NODE)), "trie-seams")
    nodes = found.where("part is null").select(*NODE).union(closed)
    above = nodes.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent_id", "left").select("id", "parent_id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
