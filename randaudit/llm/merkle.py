"""Manifest of a dataset: a Merkle tree for each group of rows, one over the groups' roots, and an authentication path for every leaf.

Leaves are ranked inside their group by range partitions and offsets, and cut into aligned blocks of 2**HEIGHT leaves. A block is
one subtree: its task climbs to the block's root first, and the blocks' roots are leaves of the next round, until every group has one node.
Then paths go down again: a block's task walks its leaves from left to right, and a stack for each level (treehash) grows the next sibling of
that level just in time, so a task holds the leaves of its block and a number of nodes in proportion to HEIGHT; the path of the block's
root, which all its leaves share, is appended. Neither a group nor the list of groups is ever in one task or on the driver.

A node is the hash of its two children; the last node of a level, where it is left over, is hashed alone and so has no sibling there.

Rows with a null group form a group, the first. Rows with a null id come first in their group; rows that share an id are ordered by leaf
and then by place, equal rows being leaves of their own. Null and empty texts are told apart (`-` and `0:`). Very long texts are hashed where they
are read and never move. Columns other than those that are hashed are left behind. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from randaudit.llm.common import stored

#: Levels of a block: blocks have 2**HEIGHT leaves, about 150 KB.
HEIGHT = 10


def field(value: Column) -> Column:
    """`-` for null, else the value's number of UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def ranked(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with pos (rank inside the tree, from 0, by `order` and then by place) and size (rows of the tree), stored in the shared folder."""
    placed = stored(nodes.withColumn("merkle_row", F.monotonically_increasing_id()), "merkle-leaves")
    dealt = placed.repartitionByRange(tree, *order, "merkle_row").sortWithinPartitions(tree, *order, "merkle_row")
    # The high bits of `at` name the partition, its low bits the place in it; both are kept by writing them.
    dealt = stored(dealt.drop("merkle_row").withColumn("at", F.monotonically_increasing_id()), "merkle-ranked").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy(F.col(tree).alias("of"), F.col("part").alias("in_part")).agg(F.min("at").alias("least"), F.count("*").alias("own"))
    # One row for each tree and partition it touches.
    whole = Window.partitionBy("of")
    before = F.sum("own").over(whole.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("of", "in_part", "least", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(whole).alias("size"))
    joined = dealt.join(offsets, (F.col(tree) == F.col("of")) & (F.col("part") == F.col("in_part")))
    return joined.withColumn("pos", F.col("at") - F.col("least") + F.col("before")).drop("of", "in_part", "least", "before", "part", "at")


def digest(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def levels(size: int) -> int:
    """Levels above the leaves of a tree of that many leaves."""
    return max(size - 1, 0).bit_length()


class Treehash:
    """Grows the node of one height over the leaves from `start` on, a step at a time: a step takes a leaf or hashes once.

    Its stack holds at most one node of each height. Beyond the last leaf of the block there is nothing, so nodes left over are
    hashed alone; a node without any leaf is the empty text.
    """

    def __init__(self, leaves: list[str], start: int, height: int):
        self.leaves, self.next, self.end, self.height = leaves, start, min(start + (1 << height), len(leaves)), height
        self.stack: list[tuple[int, str]] = []
        self.node = "" if start >= len(leaves) else None

    def tail(self) -> int:
        """Height of the lowest node on the stack; the height aimed at before the first step."""
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (h, right), (_, left) = stack.pop(), stack.pop()
            stack.append((h + 1, digest(left, right)))
        elif self.next < self.end:
            stack.append((0, self.leaves[self.next]))
            self.next += 1
        elif stack[-1][0] < self.height:
            h, alone = stack.pop()
            stack.append((h + 1, digest(alone, "")))
        if self.next == self.end and len(stack) == 1 and stack[0][0] == self.height:
            self.node = stack[0][1]

    def finish(self) -> str:
        while self.node is None:
            self.step()
        return self.node


def block_root(leaves: list[str], height: int) -> str:
    return Treehash(leaves, 0, height).finish()


def paths(leaves: list[str], height: int) -> Iterator[list[str]]:
    """Siblings of each leaf of a block, from its level up; the empty text where a node has none.

    The schedule of logarithmic traversal: level h needs a new sibling after every 2**h leaves, and after each leaf at most
    2 * height - 1 steps go to the level whose stack has the lowest tail (ties: the lowest level).
    """
    path = [Treehash(leaves, 1 << h, h).finish() for h in range(height)]
    # What each level needs next, to the left of its first sibling.
    growing = [Treehash(leaves, 0, h) for h in range(height)]
    for own in growing:
        own.finish()
    for i in range(len(leaves)):
        yield path
        if i + 1 == len(leaves):
            return
        path = path.copy()
        for h in range(height):
            if (i + 1) % (1 << h):
                break
            path[h] = growing[h].finish()
            growing[h] = Treehash(leaves, (i + 1 + (1 << h)) ^ (1 << h), h)
        for _ in range(2 * height - 1):
            open_levels = [g for g in growing if g.node is None]
            if not open_levels:
                break
            min(open_levels, key=lambda g: (g.tail(), g.height)).step()


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def block_roots(nodes: DataFrame, tree: str, block: int) -> DataFrame:
    """tree, pos, node, size of the next round: the root of each block of the nodes (tree, pos, node, size)."""

    def run(group: pa.Table) -> pa.Table:
        own = _in_order(group)
        size, pos = own["size"][0].as_py(), own["pos"][0].as_py()
        root = block_root(own["node"].to_pylist(), min(block, levels(size)))
        row = {tree: own[tree].slice(0, 1), "pos": [pos >> block], "node": [root], "size": [-(-size >> block)]}
        return pa.table(row, schema=pa.schema([(tree, own.schema.field(tree).type), ("pos", pa.int64()), ("node", pa.string()), ("size", pa.int64())]))

    keyed = nodes.select(F.col(tree), "pos", "node", "size", F.shiftright("pos", block).alias("block"))
    kind = nodes.schema[tree].dataType.simpleString()
    return keyed.groupBy(tree, "block").applyInArrow(run, f"`{tree}` {kind}, pos long, node string, size long")


def block_paths(nodes: DataFrame, upper: DataFrame, tree: str, carried: list[str], block: int) -> DataFrame:
    """The nodes with path (siblings upwards), sides (bit k set: the sibling of level k stands to the left) and the columns
    `carried` of upper, whose rows (tree, pos, path, sides, carried) are those of the blocks' roots."""
    kept = [f for f in nodes.schema.fields if f.name != "size"]

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        own = _in_order(group)
        height = min(block, levels(own["size"][0].as_py())) if len(own) else 0
        top, sides = above["path"][0].as_py(), above["sides"][0].as_py()
        places = range(len(own))
        found = {f.name: own[f.name] for f in kept}
        found["path"] = pa.array([p + top for p in paths(own["node"].to_pylist(), height)], type=pa.list_(pa.string()))
        found["sides"] = pa.array([i | sides << height for i in places], type=pa.int64())
        found |= {c: pa.array([above[c][0].as_py()] * len(own), type=pa.string()) for c in carried}
        return pa.table(found)

    left = nodes.withColumn("block", F.shiftright("pos", block))
    right = upper.select(F.col(tree), F.col("pos").alias("block"), "path", "sides", *carried)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["path array<string>", "sides long"] + [f"{c} string" for c in carried])
    return left.groupBy(tree, "block").cogroup(right.groupBy(tree, "block")).applyInArrow(run, ddl)


def climbed(nodes: DataFrame, tree: str, block: int) -> list[DataFrame]:
    """Nodes round by round (tree, pos, node, size), stored: the given ones, the blocks' roots, and so on to one node for each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size").alias("n")).first().n or 0) > 1:
        rounds.append(stored(block_roots(rounds[-1], tree, block), "merkle-round"))
    return rounds


def descended(rounds: list[DataFrame], tops: DataFrame, tree: str, carried: list[str], block: int) -> DataFrame:
    """Paths for the first of the rounds, from the last one's (tree, pos, path, sides, carried) down."""
    upper = tops
    for k in range(len(rounds) - 2, -1, -1):
        upper = block_paths(rounds[k], upper, tree, carried, block)
        if k:
            upper = stored(upper, "merkle-paths")
    return upper


def authenticated(leaves: DataFrame, tree: str, *order: str, block: int = HEIGHT) -> DataFrame:
    """The leaves (tree, order, node, more columns) with subroot, root, path (siblings of each level, the empty text for none) and sides.

    The column `tree` names a leaf's group, is never null, and orders the groups.
    """
    own = ranked(leaves, tree, *order)
    rounds = climbed(stored(own, "merkle-nodes"), tree, block)
    # Groups that have no more than one leaf left are in the last round, or were from the start.
    subroots = rounds[-1].select(F.col(tree), F.col("node"))
    top = ranked(subroots.withColumn("all", F.lit(0)), "all", tree)
    above = climbed(stored(top, "merkle-top"), "all", block)
    root = above[-1].select("all", "pos", F.array().cast("array<string>").alias("path"), F.lit(0).cast("long").alias("sides"), F.col("node").alias("root"))
    if len(above) > 1:
        root = descended(above, root, "all", ["root"], block)
    else:  # a single group, or none
        root = root.join(above[0].select("all", tree, "node"), "all")
    tops = root.select(F.col(tree), F.lit(0).cast("long").alias("pos"), "path", "sides", "root", F.col("node").alias("subroot"))
    if len(rounds) == 1:  # every group is a single leaf
        return rounds[0].drop("size").join(tops.drop("pos"), tree)
    return descended(rounds, tops, tree, ["root", "subroot"], block)


def folded(node: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    steps = F.transform("path", lambda s, k: F.struct(s.alias("s"), F.expr("sides").alias("sides"), k.alias("k")))
    left = lambda x: F.getbit(x["sides"], x["k"]) == 1
    return F.aggregate(steps, node, lambda acc, x: F.sha2(F.when(left(x), F.concat(x["s"], acc)).otherwise(F.concat(acc, x["s"])).cast("binary"), 256))


def manifest(docs: DataFrame, block: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, claimed (the leaf of a tampered copy), subroot, root, path, sides of every row; leaves hash doc_id, source, lang, n_chars and text.

    The tampered copy has n_chars + 1 where 7 divides the crc32 of the decimal doc_id and n_chars isn't null; elsewhere it equals the row.
    """
    i, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    tampered = (F.crc32(i.cast("string").cast("binary")) % 7 == 0) & n.isNotNull()
    hashed = lambda count: leaf(i, F.col("source"), F.col("lang"), count, F.col("text"))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # the null group comes first
    own = docs.select(i.alias("doc_id"), group.alias("tree"), hashed(n).alias("node"), F.when(tampered, hashed(n + 1)).alias("other"))
    found = authenticated(own, "tree", "doc_id", "node", block=block)
    return found.select("doc_id", F.col("node").alias("leaf"), F.coalesce("other", "node").alias("claimed"), "subroot", "root", "path", "sides")


def report(docs: DataFrame, block: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    found = manifest(docs, block).withColumn("folded_root", folded(F.col("claimed")))
    proof = F.sha2(F.array_join("path", "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
