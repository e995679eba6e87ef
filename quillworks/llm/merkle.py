"""A dataset manifest: one Merkle tree a source and one over the sources, with every row's authentication path."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions

#: Nodes that make one of the next level.
ARITY = 3
#: Levels within an aligned block: 3 ** 7 leaves.
LEVELS = 7
#: One level of a path: hex digests of the siblings before and after a node, end to end.
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 bytes counted, ``:``, and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """A row's digest: lowercase hex SHA-256 of its fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(proof, node, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def joined(nodes: Iterable[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """A stack that takes leaves one by one and gives the node of ``level`` once it has them all.

    It holds at most two nodes a level. ``end`` closes a tree that has fewer leaves: runs cut short become nodes as they are.
    """

    def __init__(self, level: int):
        self.level, self.rows = level, [[] for _ in range(level + 1)]

    def push(self, node: bytes) -> bytes | None:
        return self._up(node, 0)

    def _up(self, node: bytes, at: int) -> bytes | None:
        while at < self.level:
            self.rows[at].append(node)
            if len(self.rows[at]) < ARITY:
                return None
            node, self.rows[at] = joined(self.rows[at]), []
            at += 1
        return node

    def end(self) -> bytes | None:
        """The node of ``level`` from what is there, None if nothing is."""
        out = None
        for at in range(self.level):
            if self.rows[at]:
                node, self.rows[at] = joined(self.rows[at]), []
                out = self._up(node, at + 1) or out
        return out


def height_of(leaves: int) -> int:
    """Levels until one node is left."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


def block_height(leaves: int, first: bool) -> int:
    """A source's only block ends where one node is left; a block among others goes all the way, as there more nodes remain."""
    return height_of(leaves) if first and leaves < ARITY**LEVELS else LEVELS


def block_root(leaves: Sequence[bytes], height: int) -> bytes:
    tree, out = Treehash(height), None
    for x in leaves:
        out = tree.push(x) or out
    return tree.end() or out


def traverse(leaves: Sequence[bytes], height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Each leaf's path within an aligned block, leaf by leaf.

    Every level keeps the run of nodes that the current leaf is under, and a treehash stack that builds the nodes of the next
    run, one leaf a step, so that they are there when the leaf passes into it. That is two runs and one stack a level.
    """
    spans = [ARITY**h for h in range(height)]
    stacks, runs, coming, read = [Treehash(h) for h in range(height)], [[] for _ in spans], [[] for _ in spans], [0] * height

    def advance(h: int) -> None:
        """One more leaf for the stack of level h."""
        if read[h] < len(leaves):
            node = stacks[h].push(leaves[read[h]])
            read[h] += 1
            if read[h] == len(leaves):
                node = stacks[h].end() or node
            if node is not None:
                coming[h].append(node)

    for h, span in enumerate(spans):  # the first run of each level
        for _ in range(ARITY * span):
            advance(h)
    for i in range(len(leaves)):
        path = []
        for h, span in enumerate(spans):
            if i % (ARITY * span) == 0:
                runs[h], coming[h] = coming[h], []
            place = i // span % ARITY
            path.append((b"".join(runs[h][:place]), b"".join(runs[h][place + 1 :])))
            advance(h)
        yield path


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with ``pos``, each one's number within its group in ``order``, from 0.

    Rows move once, to ranges of (group, order), and are numbered there; the numbers of a group's rows in earlier ranges come from one
    count a range and group. A group of any size is spread over as many ranges as it needs, and rows alike in all of ``order`` too.
    """
    n = partitions(rows.sparkSession)
    at, part = fresh(rows, "_at", "_part")
    rows = rows.withColumn(at, F.monotonically_increasing_id())  # parts rows that are alike
    rows = rows.repartitionByRange(n, group, *order, at).sortWithinPartitions(group, *order, at)
    rows = scratch.write(rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), name + "-ranged")
    counts = rows.groupBy(group, part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_g"), F.col(part).alias("_p"), (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = rows.join(counts, (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")))
    out = out.withColumn("pos", F.col(at) + F.col("_shift")).drop(at, part, "_g", "_p", "_shift")
    return out


def _root(table: pa.Table) -> pa.Table:
    """One block's (key, block, root)."""
    nodes = [x.encode() for x in table.sort_by("pos").column("node").to_pylist()]
    root = block_root(nodes, block_height(len(nodes), table.column("block")[0].as_py() == 0))
    return table.slice(0, 1).select(["key", "block"]).append_column("root", pa.array([root.decode()]))


def paths(scratch: Scratch, nodes: DataFrame, name: str, carry: str = "", over: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, pos, node, carried columns, proof, root) of every node: key, pos from 0 within its key, node as hex, and columns of the DDL ``carry``.

    Aligned blocks of 3 ** LEVELS nodes become one root each, and these again, until a key has one block. Then each block's
    task walks its leaves and appends to every path the one that the block's root has above it. ``over`` may lengthen those (key, block, proof, root).
    """
    nodes = scratch.write(nodes.withColumn("block", F.expr(f"pos div {ARITY**LEVELS}")), name)
    roots = nodes.select("key", "block", "pos", "node").groupBy("key", "block").applyInArrow(_root, "key string, block long, root string")
    roots = scratch.write(roots, name + "-roots")
    if roots.where("block > 0").isEmpty():
        above = roots.select("key", "block", F.array().cast(PROOF).alias("proof"), "root")
    else:
        above = paths(scratch, roots.select("key", F.col("block").alias("pos"), F.col("root").alias("node")), name + "-up")
        above = above.select("key", F.col("pos").alias("block"), "proof", "root")
    if over:
        above = over(above)
    return append_paths(nodes, scratch.write(above, name + "-above"), carry)


def append_paths(nodes: DataFrame, above: DataFrame, carry: str) -> DataFrame:
    """Walks each block of ``nodes`` and appends what its root has above it: one row of ``above`` (key, block, proof, root) a block."""
    schema = f"key string, pos long, node string, {carry + ', ' if carry else ''}proof {PROOF}, root string"
    kept = [c for c in nodes.columns if c not in ("key", "block", "pos", "node")]
    wanted = ["key", "pos", "node", *kept]
    pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def walk(leaves: pa.Table, up: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        found = [x.encode() for x in leaves.column("node").to_pylist()]
        if found:
            upper = up.column("proof")[0].as_py()
            height = block_height(len(found), leaves.column("block")[0].as_py() == 0)
            proofs = [[{"left": a.decode(), "right": b.decode()} for a, b in path] + upper for path in traverse(found, height)]
            root = [up.column("root")[0].as_py()] * len(found)
        else:
            proofs, root = [], []
        out = leaves.select(wanted)
        return out.append_column("proof", pa.array(proofs, pair)).append_column("root", pa.array(root, pa.string()))

    return nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(walk, schema)


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: id, source, leaf, subroot, root, proof and, with ``altered``, altered_leaf.

    The leaf is the SHA-256 of ``fields``. Per source, leaves ascend by id (then by leaf) under a tree of runs of three; the subroots,
    by source, are under another. ``proof`` has a row's siblings level by level, those of its source's root last, so that
    folded(leaf, proof) is the root. ``altered`` has columns that stand in for some of ``fields``: altered_leaf is the leaf with these.

    Texts are hashed where they are read; only ids, sources and digests move. A source of any size is cut into aligned blocks of
    3 ** LEVELS leaves, one task works on a block at a time, and blocks' roots go up the same way.

    Null source: a source of its own, before all others. Null ids come first. Null and empty values differ. Repeated rows have leaves that
    are alike, each with a place and path of its own. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    plain = [F.col(f"`{c}`") for c in fields]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        # Null first, then by bytes.
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("key"),
        leaf(*plain).alias("node"),
        (leaf(*((altered or {}).get(c, v) for c, v in zip(fields, plain, strict=True))) if altered else F.lit(None).cast("string")).alias("altered"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    leaves = numbered(scratch, rows, "key", ["id", "node"], "leaves")

    def over(blocks: DataFrame) -> DataFrame:
        """What a block's root has above it in its source, then what the source's root has above it. Both roots go as one text."""
        blocks = scratch.write(blocks, "subtrees")
        tops = blocks.where("block = 0").select(F.lit("").alias("all"), "key", F.col("root").alias("node"))
        tops = numbered(scratch, tops, "all", ["key"], "sources").select(F.col("all").alias("key"), "pos", "node", F.col("key").alias("source"))
        tops = paths(scratch, tops, "top", "source string").select(F.col("source").alias("key"), F.col("proof").alias("top"), F.col("root").alias("whole"))
        return blocks.join(tops, "key").select("key", "block", F.concat("proof", "top").alias("proof"), F.concat("root", F.lit(" "), "whole").alias("root"))

    out = paths(scratch, leaves, "tree", f"id {kind}, altered string", over)
    names = [F.col("id").alias(id_col), F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias(source_col), F.col("node").alias("leaf"), F.split("root", " ")[0].alias("subroot"), F.split("root", " ")[1].alias("root"), "proof"]
    return out.select(*names, *([F.col("altered").alias("altered_leaf")] if altered else []))
