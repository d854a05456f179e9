"""A Merkle manifest of a dataset: hash trees of three children, kept as append logs in completion order.

Leaves are ordered within their source. Builders work on aligned blocks of 3 ** HEIGHT leaves; each appends the nodes
of its subtree in the order in which they are completed, children before parents. The roots of the blocks are the
leaves of the next tier, until one node is left per source; the subroots make the last tree in the same way. In such
a log the place of a node follows from the sizes of the subtrees before it (``postorder``), so proofs are read by
address: within the block, then the proof of the block's root is joined on.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.ordering import null_safe_join, ranked
from gleanery.session import materialize

#: Children of a node.
FAN = 3
#: Levels of a block: 729 leaves and at most 1 093 nodes.
HEIGHT = 6


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def postorder(level: int, index: int, leaves: int, height: int) -> int:
    """The place (from 0) of a node in the log of a tree with ``leaves`` leaves and levels 0 to ``height``.

    When a node is completed, so are at each level up to its own all nodes that end where it ends or before, and at
    each level above all that end before it begins.
    """
    begin, end = index * FAN**level, min((index + 1) * FAN**level, leaves)
    done = sum(-(-end // FAN**j) for j in range(level + 1))
    return done + sum(begin // FAN**j for j in range(level + 1, height + 1)) - 1


def height_of(leaves: int) -> int:
    """The level at which one node is left."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // FAN), level + 1
    return level


def completion_order(leaves: list[str], height: int) -> list[tuple[int, int, str]]:
    """(level, index, digest) of all nodes of a subtree, each run of children closed as soon as it is full or ends."""
    out, open_runs, counts = [], [[] for _ in range(height + 1)], [0] * (height + 1)
    for i, leaf in enumerate(leaves):
        node, last = leaf, i == len(leaves) - 1
        for level in range(height + 1):
            out.append((level, counts[level], node))
            counts[level] += 1
            if level == height:
                break
            open_runs[level].append(node)
            if len(open_runs[level]) < FAN and not last:
                break
            node = hashlib.sha256("".join(open_runs[level]).encode()).hexdigest()
            open_runs[level] = []
    return out


def _block_shape(n: int, block: int, levels: int) -> tuple[int, int]:
    """Leaves of a block of a tree with ``n`` leaves, and its height: ``levels`` unless it is the whole tree."""
    whole = FAN**levels
    return min(whole, n - block * whole), (height_of(n) if n <= whole else levels)


_LOG = "block long, at long, level int, index long, digest string, n long, leaves long, top boolean"


def _append(nodes: DataFrame, tier: int, levels: int) -> DataFrame:
    """The log of one tier. ``nodes``: key, rank, n (of this tier), leaves (of the whole tree), digest, of."""
    kept = nodes.select("key", F.floor(F.col("rank") / FAN**levels).cast("long").alias("block"), "rank", "n", "leaves", "digest", "of")
    of = kept.schema["of"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rank")
        block, n, leaves = (table.column(c)[0].as_py() for c in ("block", "n", "leaves"))
        _, height = _block_shape(n, block, levels)
        found = completion_order(table.column("digest").to_pylist(), height)
        sizes = [FAN ** (levels - h) for h in range(height + 1)]
        count = len(found)
        taken = pa.array([i if level == 0 else None for level, i, _ in found], pa.int64())
        return pa.table({
            "key": pa.array([table.column("key")[0].as_py()] * count, table.schema.field("key").type),
            "block": pa.array([block] * count, pa.int64()), "at": pa.array(range(count), pa.int64()),
            "level": pa.array([level + tier * levels for level, _, _ in found], pa.int32()),
            "index": pa.array([block * sizes[level] + i for level, i, _ in found], pa.int64()),
            "digest": pa.array([x for _, _, x in found], pa.string()),
            "n": pa.array([n] * count, pa.int64()), "leaves": pa.array([leaves] * count, pa.int64()),
            "top": pa.array([i == count - 1 for i in range(count)]), "of": table.column("of").take(taken),
        })

    key = kept.schema["key"].dataType.simpleString()
    return materialize(kept.groupBy("key", "block").applyInArrow(build, f"key {key}, {_LOG}, of {of}"), f"log-{tier}")


class Tree(NamedTuple):
    """``tiers``: logs from the leaves up. ``roots``: key, digest. ``levels``: height of a block."""

    tiers: list[DataFrame]
    roots: DataFrame
    levels: int


def build_trees(leaves: DataFrame, levels: int = HEIGHT) -> Tree:
    """One tree per key, in blocks of 3 ** ``levels`` leaves, over ``leaves``: key, rank, n, digest, of (whatever a leaf stands for)."""
    nodes, tiers, roots = leaves.withColumn("leaves", F.col("n")), [], None
    while True:
        log = _append(nodes, len(tiers), levels)
        tiers.append(log)
        top = log.filter("top").withColumn("blocks", F.ceil(F.col("n") / FAN**levels).cast("long"))
        done = top.filter("blocks = 1").select("key", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if (top.agg(F.max("blocks")).first()[0] or 0) <= 1:
            return Tree(tiers, roots, levels)
        above = top.filter("blocks > 1")
        nodes = above.select("key", F.col("block").alias("rank"), F.col("blocks").alias("n"), "leaves", "digest", F.lit(None).cast("string").alias("of"))


def append_log(tree: Tree) -> DataFrame:
    """All nodes: key, pos (place in the log of the key's whole tree), level, index, digest."""

    @F.pandas_udf("long")
    def place(level, index, leaves):
        import pandas as pd

        return pd.Series([postorder(int(a), int(b), int(c), height_of(int(c))) for a, b, c in zip(level, index, leaves, strict=True)])

    parts = [t if i == 0 else t.filter(F.col("level") > i * tree.levels) for i, t in enumerate(tree.tiers)]
    out = None
    for part in parts:
        part = part.select("key", place("level", "index", "leaves").alias("pos"), "level", "index", "digest")
        out = part if out is None else out.unionByName(part)
    return out


_STEPS = "array<struct<left: string, right: string>>"


def _siblings(log: DataFrame, levels: int) -> DataFrame:
    """Per leaf of a tier: key, block, rank, digest, of, n and ``proof``, its siblings up to the root of its block."""
    schema = f"key {log.schema['key'].dataType.simpleString()}, block long, rank long, digest string, n long, of {log.schema['of'].dataType.simpleString()}, proof {_STEPS}"

    def extract(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("at")
        block, n = table.column("block")[0].as_py(), table.column("n")[0].as_py()
        node = table.column("digest").to_pylist()
        leaves, height = _block_shape(n, block, levels)
        left, right = [], []
        for i in range(leaves):
            for level in range(height):
                own = i // FAN**level
                first, stop = own // FAN * FAN, min(own // FAN * FAN + FAN, -(-leaves // FAN**level))
                left.append("".join(node[postorder(level, j, leaves, height)] for j in range(first, own)))
                right.append("".join(node[postorder(level, j, leaves, height)] for j in range(own + 1, stop)))
        at = pa.array([postorder(0, i, leaves, height) for i in range(leaves)], pa.int64())
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, leaves * height + 1, height) if height else [0] * (leaves + 1), pa.int32()), steps)
        rows = table.take(at)
        return pa.table({
            "key": rows.column("key"), "block": rows.column("block"), "rank": rows.column("index").cast(pa.int64()),
            "digest": rows.column("digest"), "n": rows.column("n"), "of": rows.column("of"), "proof": proof})

    # index counts at the level of the tier, so it is the rank there
    return log.groupBy("key", "block").applyInArrow(extract, schema)


def proofs(tree: Tree) -> DataFrame:
    """Per leaf: key, digest, of, ``proof`` (level by level what stands left and right of its path)."""
    upper = None
    for log in reversed(tree.tiers):
        own = _siblings(log, tree.levels)
        if upper is not None:
            above = upper.select("key", F.col("rank").alias("block"), F.col("proof").alias("__above"))
            own = null_safe_join(own, above, ["key", "block"], "left")
            own = own.withColumn("proof", F.concat("proof", F.coalesce("__above", F.array().cast(_STEPS)))).drop("__above")
        upper = own
    return upper


def fold(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def certify(leaves: DataFrame, levels: int = HEIGHT) -> DataFrame:
    """Manifest with a proof per row. ``leaves``: source, doc_id, leaf, claim (the leaf to verify; null: ``leaf``).

    Returns doc_id, leaf, subroot, root, proof, folded_root, verified. Leaves ascend by doc_id within a source, null
    ids first; rows with one id are ordered by leaf and claim. The null source is a source of its own and stands first. A
    source of one row is its own subroot, one source alone its own root; an empty table gives an empty result.
    Only digests and ids are written or shuffled; a block never holds more than 3 ** ``levels`` leaves, whatever the
    size of its source.
    """
    rows = ranked(leaves.select("source", "doc_id", "leaf", "claim"), ["source"], ["doc_id", "leaf", "claim"], "leaves")
    of = F.struct("doc_id", F.coalesce("claim", "leaf").alias("claim")).alias("of")
    tree = build_trees(rows.select(F.col("source").alias("key"), "rank", "n", F.col("leaf").alias("digest"), of), levels)
    sources = tree.roots.select(F.lit(0).alias("key"), F.col("key").alias("source"), "digest")
    sources = ranked(sources, ["key"], ["source"], "sources").withColumn("of", F.struct("source"))
    crown = build_trees(sources.select("key", "rank", "n", "digest", "of"), levels)
    root = crown.roots.select("key", F.col("digest").alias("__root"))
    # one row: the root of the one tree over all sources
    tops = proofs(crown).join(F.broadcast(root), "key").select(F.col("of.source").alias("key"), F.col("digest").alias("subroot"), F.col("proof").alias("__top"), F.col("__root").alias("root"))
    out = null_safe_join(proofs(tree), tops, ["key"]).withColumn("proof", F.concat("proof", "__top"))
    out = out.withColumn("folded_root", fold(F.col("of.claim"), F.col("proof")))
    return out.select(
        F.col("of.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
