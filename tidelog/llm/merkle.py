"""Merkle manifest of a dataset: trees of eight, kept as blocks in van Emde Boas order.

Every row is a leaf; each `lang` has a tree over its leaves by doc_id, and the roots of these trees are the leaves of one
more tree. A tree is cut into blocks: aligned subtrees of BLOCK_LEVELS levels above their leaves. The roots of its blocks
are the leaves of the next tier of blocks, until one block is left. So no task ever holds more than one block, and the
number of tiers grows with the logarithm of the rows.

Inside a block the nodes lie in van Emde Boas order: the tree is split at half its height, the upper subtree lies first,
then the lower ones from left to right, each laid out in the same way. `address` finds a node by arithmetic alone; it
serves the construction, which completes small subtrees before the larger ones that hold them, and the
retrieval of siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import ascii_lower, numbered, same, slices, written

ARITY = 8
BLOCK_LEVELS = 4  # a block has up to ARITY ** BLOCK_LEVELS leaves
SIZE = 32  # bytes of a node
PATH = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_in(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(depth: int, index: int, levels: int) -> int:
    """Where a full tree of `levels` levels keeps node `index` of the level at `depth` (the root is at 0)."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        subtree, index = divmod(index, ARITY ** depth)
        at += nodes_in(upper) + subtree * nodes_in(levels)
    return at


def fill(nodes: list[str | None], levels: int, width: int, base: int = 0) -> None:
    """Computes the inner nodes of the tree of `levels` levels that lies at `base` and has `width` leaves, which are in place."""
    if levels == 1:
        return
    upper, lower = levels // 2, levels - levels // 2
    span, step, first = ARITY ** (lower - 1), nodes_in(lower), base + nodes_in(upper)
    subtrees = -(-width // span)
    for i in range(subtrees):
        fill(nodes, lower, min(span, width - i * span), first + i * step)
    parents = -(-subtrees // ARITY)
    for i in range(parents):
        children = range(first + i * ARITY * step, first + min(subtrees, (i + 1) * ARITY) * step, step)
        nodes[base + address(upper - 1, i, upper)] = digest("".join(nodes[c] for c in children))
    fill(nodes, upper, parents, base)


def levels_of(width: int, whole: bool, block_levels: int) -> int:
    """Levels of a block, leaves included: all of them in a tree of several blocks, else until one node is left."""
    if whole:
        return block_levels + 1
    levels = 1
    while ARITY ** (levels - 1) < width:
        levels += 1
    return levels


def block(leaves: list[str], whole: bool, block_levels: int) -> tuple[bytes, int]:
    """The nodes of a block in van Emde Boas order, and the number of its levels. Places without a node are zero."""
    levels = levels_of(len(leaves), whole, block_levels)
    nodes: list[str | None] = [None] * nodes_in(levels)
    for i, leaf in enumerate(leaves):
        nodes[address(levels - 1, i, levels)] = leaf
    fill(nodes, levels, len(leaves))
    return b"".join(bytes(SIZE) if n is None else bytes.fromhex(n) for n in nodes), levels


def runs_of(nodes: bytes, levels: int, width: int) -> list[list[str]]:
    """Per level, from the leaves to below the root, its runs of children: the hex digests of one parent's children as one text."""
    found = []
    for depth in range(levels - 1, 0, -1):
        at = [SIZE * address(depth, i, levels) for i in range(width)]
        digests = [nodes[a:a + SIZE].hex() for a in at]
        found.append(["".join(digests[i:i + ARITY]) for i in range(0, width, ARITY)])
        width = -(-width // ARITY)
    return found


def siblings(runs: list[list[str]], index: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf and of the nodes above it, up to the root of its block."""
    found = []
    for level in runs:
        run, child = level[index // ARITY], index % ARITY * 2 * SIZE
        found.append((run[:child], run[child + 2 * SIZE:]))
        index //= ARITY
    return found


@dataclass
class Forest:
    """Trees of blocks. `tiers` from the leaves up: (tree, block, width, levels, nodes). `roots`: (tree, root)."""

    tiers: list[DataFrame]
    roots: DataFrame
    block_levels: int


@dataclass
class Manifest:
    """`leaves`: (doc_id, tree, number, leaf, other), tree being the lang; `trees`: a tree per lang; `top`: the tree over their
    roots; `order`: (number, tree, node) of the subroots."""

    leaves: DataFrame
    trees: Forest
    top: Forest
    order: DataFrame


def forest(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> Forest:
    """Trees over `leaves(tree, number, node)`, numbers from 0 in each tree, nodes in hex. Each tier is written once."""
    width = ARITY ** block_levels
    kind = leaves.schema["tree"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        number = table.column("block")[0].as_py()
        given = table.column("node").to_pylist()
        # A first block that isn't full is the only one.
        nodes, levels = block(given, number > 0 or len(given) == width, block_levels)
        return pa.table([table.column("tree").slice(0, 1), pa.array([number]), pa.array([len(given)], pa.int32()),
                         pa.array([levels], pa.int32()), pa.array([nodes], pa.binary())], ["tree", "block", "width", "levels", "nodes"])

    tiers, roots, now = [], None, leaves.select("tree", "number", "node")
    while True:
        tier = written(now.withColumn("block", F.floor(F.col("number") / width).cast("long")).groupBy("tree", "block")
                       .applyInArrow(build, f"tree {kind}, block long, width int, levels int, nodes binary"), "tier")
        tiers.append(tier)
        top = tier.select("tree", "block", F.lower(F.hex(F.substring("nodes", 1, SIZE))).alias("node"))
        several = tier.where("block > 0").select("tree").distinct()
        done = top.alias("t").join(several.alias("s"), same("t", "s", "tree"), "left_anti").select("tree", F.col("node").alias("root"))
        roots = done if roots is None else roots.union(done)
        if several.isEmpty():
            return Forest(tiers, roots, block_levels)
        now = top.alias("t").join(several.alias("s"), same("t", "s", "tree"), "left_semi").select("tree", F.col("block").alias("number"), "node")


def _paths(trees: Forest, above: DataFrame) -> DataFrame:
    """(tree, block, width, levels, nodes, path, ...) of the lowest tier: path has the siblings from a block's root up to
    the very top. `above(tree, path, ...)` has those from the roots of the trees."""
    width = ARITY ** trees.block_levels
    more = [name for name in above.columns if name not in ("tree", "path")]
    kind = above.schema["tree"].dataType.simpleString()

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            runs = runs_of(row["nodes"], row["levels"], row["width"])
            rest = [(x["left"], x["right"]) for x in row["path"]]
            paths = [[{"left": a, "right": b} for a, b in siblings(runs, i) + rest] for i in range(row["width"])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([0] * row["width"])), pa.array([row["block"] * width + i for i in range(row["width"])], pa.int64()),
                pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], ["tree", "block", "path"])

    below = None  # (tree, block, path) of the blocks of the tier at hand that have blocks above them
    for tier in reversed(trees.tiers):
        placed = tier.alias("t").join(above.alias("a"), same("t", "a", "tree"))
        path = F.col("a.path")
        if below is not None:
            placed = placed.join(below.alias("b"), same("t", "b", "tree", "block"), "left")
            path = F.coalesce("b.path", "a.path")
        placed = placed.select("t.*", path.alias("path"), *(F.col(f"a.{name}") for name in more))
        below = placed.select("tree", "block", "width", "levels", "nodes", "path").mapInArrow(down, f"tree {kind}, block long, path {PATH}")
    return placed


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """H of a row: doc_id, source, lang, n_chars, text, each `-` if null, else its UTF-8 bytes counted, `:` and itself."""
    values = [F.col(name).cast("string") for name in ("doc_id", "source", "lang", "n_chars")] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


def build(docs: DataFrame, other: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of `docs(doc_id, text, lang, source, n_chars)`; further columns have no say.

    Leaves go by doc_id, null first, rows with one doc_id by digest; repeated rows are leaves each. A null lang has a tree of its
    own, which comes first. An empty table has no trees. `other`: a digest that is kept beside each leaf, to be held against it.
    """
    given = docs.select("doc_id", F.col("lang").alias("tree"), leaf(docs).alias("leaf"), (leaf(docs) if other is None else other).alias("other"))
    leaves = numbered(given, "tree", "doc_id", "leaf")
    trees = forest(leaves.select("tree", "number", F.col("leaf").alias("node")), block_levels)
    order = numbered(trees.roots.select(F.lit(0).alias("all"), "tree", F.col("root").alias("node")), "all", "tree")
    return Manifest(leaves, trees, forest(order.select(F.col("all").alias("tree"), "number", "node"), block_levels), order)


def proofs(made: Manifest) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, path) per row: path has a (left, right) pair of hex texts per level, which beside
    the digest so far give the next one. A block and its leaves meet in one task."""
    top = _paths(made.top, made.top.roots.select("tree", F.array().cast(PATH).alias("path"), "root"))
    ends = _inside(top.select(F.col("tree").alias("t"), "block", "width", "levels", "nodes", "path", F.lit("").alias("subroot"), "root"),
                   made.order.select(F.col("all").alias("t"), "number", F.lit(None).cast("long").alias("doc_id"), F.col("node").alias("leaf"),
                                     F.col("node").alias("other")), made.top.block_levels, number=True)
    above = ends.alias("e").join(made.order.alias("o"), F.col("e.number") == F.col("o.number")).select("o.tree", "e.path", F.col("e.leaf").alias("subroot"), "e.root")
    low = _paths(made.trees, above).withColumnRenamed("tree", "t")
    return _inside(low, made.leaves.withColumnRenamed("tree", "t"), made.trees.block_levels, number=False)


def _inside(blocks: DataFrame, leaves: DataFrame, block_levels: int, number: bool) -> DataFrame:
    """Leaves (t, number, doc_id, leaf, other) with the siblings that their blocks know, followed by the blocks' own paths."""
    width = ARITY ** block_levels
    key = "number" if number else "doc_id"
    kind = leaves.schema[key].dataType.simpleString()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        runs = runs_of(row["nodes"], row["levels"], row["width"])
        rest = [(x["left"], x["right"]) for x in row["path"]]
        paths = [[{"left": a, "right": b} for a, b in siblings(runs, n % width) + rest] for n in left.column("number").to_pylist()]
        same_for_all = [pa.array([row[name]] * left.num_rows, pa.string()) for name in ("subroot", "root")]
        return pa.table([left.column(key), left.column("leaf"), left.column("other"), *same_for_all,
                         pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))],
                        [key, "leaf", "other", "subroot", "root", "path"])

    placed = leaves.withColumn("block", F.floor(F.col("number") / width).cast("long"))
    return (placed.groupBy("t", "block").cogroup(blocks.groupBy("t", "block"))
            .applyInArrow(look_up, f"{key} {kind}, leaf string, other string, subroot string, root string, path {PATH}"))


def checked(proven: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of `proofs`: the digest of all siblings, and the root
    that follows from `other` and them."""
    kind = proven.schema["doc_id"].dataType.simpleString()

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            seen, folded = [], []
            for node, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen.append(digest("".join(x["left"] + x["right"] for x in path)))
                for x in path:
                    node = digest(x["left"] + node + x["right"])
                folded.append(node)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 3, 4, 5)), pa.array(seen, pa.string()), pa.array(folded, pa.string())],
                                             ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    out = proven.select("doc_id", "other", "path", "leaf", "subroot", "root").mapInArrow(
        fold, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has lost its capitals A-Z, where 3 divides the checksum of the doc_id; else the leaf."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return leaf(docs, F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text")))
