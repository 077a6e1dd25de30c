"""Merkle dataset manifest by time-forward processing: digests travel up, proof suffixes travel back down.

Every node of the tree has a label: the last leaf below it, then its height. Children come before their parent, so a sweep in
label order with a priority queue can hand each digest to its parent just before the parent is worked on. The queue is external:
a task sweeps blocks of 3^HEIGHT consecutive leaves with a small heap, and what is addressed to nodes above a block goes
through the shuffle, sorted by label, to the next round. The sweep back goes through the rounds in reverse: each block
receives the proof suffix of its top node and delivers longer ones to its leaves, in falling order of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.llm.common import cut

#: Nodes that share a parent.
RUN = 3
#: Levels that one round climbs, so a block has 3^6 = 729 leaves; 10^11 leaves take four rounds.
HEIGHT = 6
#: Hexadecimal digits of a digest.
DIGEST = 64


def text_digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, each as `-` if null, else as its UTF-8 byte count, `:` and its value."""
    sized = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def joined_digest(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def in_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with place (from 0, within the group, by the ``order`` columns, null first) and n (rows of the group).

    Rows are range-partitioned, so a hot group lies in many tasks; only counts for each group and task meet.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    spread = cut(spread.withColumn("_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("_task", F.shiftright("_at", 33))
    held = spread.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    by_group = Window.partitionBy(group)
    earlier = by_group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("n", F.sum("_here").over(by_group)).withColumn("_before", F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
    return spread.join(held.drop("_here"), [group, "_task"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before")


def _height(leaves: int, most: int = HEIGHT) -> int:
    """Levels above the leaves until one node is left, or ``most``."""
    height = 0
    while leaves > 1 and height < most:
        leaves, height = -(-leaves // RUN), height + 1
    return height


def sweep_up(leaves: list[str], height: int) -> list[list[str]]:
    """The digests of each level of a block, in the order in which the queue delivers them to their parents."""
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    queue: list[tuple[int, int, int, str]] = []  # (last leaf below the parent, its height, child, digest)

    def node(level: int, digest: str) -> None:
        place = len(levels[level])
        levels[level].append(digest)
        if level < height:
            last = min((place // RUN + 1) * RUN ** (level + 1), len(leaves)) - 1
            heappush(queue, (last, level + 1, place, digest))

    for i, leaf in enumerate(leaves):
        node(0, leaf)
        while queue and queue[0][0] <= i:
            last, level = queue[0][:2]
            children = []
            while queue and queue[0][:2] == (last, level):
                children.append(heappop(queue)[3])
            node(level, joined_digest(children))
    return levels


def sweep_down(levels: list[list[str]], suffix: str) -> list[str]:
    """Proof of each leaf of a block whose top node has the proof ``suffix``.

    A proof is a text of steps from the leaf upwards: place in the run, size of the run, then the digests of the others.
    """
    proofs = [""] * len(levels[0])
    width = RUN ** (len(levels) - 1)
    queue = [(-width, 1 - len(levels), 0, suffix)]  # (-last leaf below, -height, place, proof)
    while queue:
        _, level, place, proof = heappop(queue)
        if not level:
            proofs[place] = proof
            continue
        level, first = -level - 1, place * RUN
        run = levels[level][first : first + RUN]
        for i in range(len(run)):
            step = f"{i}{len(run)}{''.join(run[:i])}{''.join(run[i + 1 :])}"
            heappush(queue, (-(first + i + 1) * RUN**level, -level, first + i, step + proof))
    return proofs


def fold(leaf: str, proof: str) -> tuple[str, str]:
    """(the digests of the proof in order, the root that the leaf and the proof lead to)."""
    at, others = 0, []
    while at < len(proof):
        place, size = int(proof[at]), int(proof[at + 1])
        end = at + 2 + (size - 1) * DIGEST
        split = at + 2 + place * DIGEST
        others.append(proof[at + 2 : end])
        leaf = sha256((proof[at + 2 : split] + leaf + proof[split:end]).encode()).hexdigest()
        at = end
    return "".join(others), leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block: consecutive ones that agree in their first two columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, block in groupby(rows, key=lambda r: r[:2]):
        yield list(block)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 8192) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


_NODE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
_NODE_SQL = "tree string, place long, n long, digest string"


def _raise(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, place, n, digest), sorted, to the top node of each block."""

    def tops() -> Iterator[tuple]:
        for block in _blocks(batches):
            tree, number, _, n, _ = block[0]
            up = height if n > RUN**height else _height(n)
            yield tree, number, -(-n // RUN**height), sweep_up([r[4] for r in block], up)[up][0]

    yield from _batched(tops(), _NODE)


class Tree(NamedTuple):
    """levels[0] the leaves (tree, place, n, digest), then the top nodes of their blocks and so on; the last holds the roots."""

    levels: list[DataFrame]
    height: int


def climb(leaves: DataFrame, height: int = HEIGHT) -> Tree:
    """Trees over leaves (tree, place, n, digest): one round for ``height`` levels, until each tree has one node."""
    levels = [leaves.select("tree", "place", "n", "digest")]
    while len(levels) == 1 or (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        nodes = levels[-1].select("tree", F.floor(F.col("place") / RUN**height).alias("block"), "place", "n", "digest")
        nodes = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        levels.append(cut(nodes.mapInArrow(partial(_raise, height=height), _NODE_SQL)))
    return Tree(levels, height)


_PROOF = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("proof", pa.string()), ("top", pa.string())])
_PROVED = pa.schema([*_PROOF, ("proof_sha256", pa.string()), ("folded", pa.string())])
_PROOF_SQL = "tree string, place long, proof string, top string"


def _lower(batches: Iterator[pa.RecordBatch], height: int, folds: bool) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, place, n, digest, claim, proof, top), where place -1 brings the block's proof, to a proof for each node."""

    def proofs() -> Iterator[tuple]:
        for (tree, _, _, _, _, _, suffix, top), *block in _blocks(batches):
            n = block[0][3]
            levels = sweep_up([r[4] for r in block], height if n > RUN**height else _height(n))
            for row, proof in zip(block, sweep_down(levels, suffix), strict=True):
                if folds:
                    others, root = fold(row[5], proof)
                    yield tree, row[2], None, top, sha256(others.encode()).hexdigest(), root
                else:
                    yield tree, row[2], proof, top

    yield from _batched(proofs(), _PROVED if folds else _PROOF)


def descend(tree: Tree, tops: DataFrame, folds: bool = False) -> DataFrame:
    """Proofs for the leaves, from those of the roots: tops (tree, proof, top), of which top is handed on unchanged.

    Rows (tree, place, proof, top). With ``folds`` the leaves have a column claim, a digest each; instead of the proof's text, which
    grows with the height of the tree, its digests' SHA-256 (proof_sha256) and the root that claim and proof lead to (folded).
    """
    messages = tops.select("tree", F.lit(0).cast("long").alias("place"), "proof", "top")
    nothing = F.lit(None).cast("string")
    for level in range(len(tree.levels) - 2, -1, -1):
        last = folds and level == 0
        nodes, block = tree.levels[level], F.floor(F.col("place") / RUN**tree.height).alias("block")
        nodes = nodes.select("tree", block, "place", "n", "digest", (F.col("claim") if last else nothing).alias("claim"), nothing.alias("proof"), nothing.alias("top"))
        brought = messages.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("n"), nothing.alias("digest"), nothing.alias("claim"), "proof", "top")
        both = nodes.unionByName(brought).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        messages = both.mapInArrow(partial(_lower, height=tree.height, folds=last), _PROOF_SQL + (", proof_sha256 string, folded string" if last else ""))
    return messages


class Manifest(NamedTuple):
    """leaves (the columns given, tree, place, n), subroots (source, tree, digest, place), root (None without rows), and the trees."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    below: Tree
    above: Tree


def manifest(rows: DataFrame, source: str = "source", order: str = "doc_id", leaf: str = "leaf", height: int = HEIGHT) -> Manifest:
    """The Merkle manifest of ``rows``: one tree for each source over leaves in the order given, and one over the subroots.

    ``leaf`` names the column with each row's digest (see text_digest), never null. Runs of three consecutive nodes become their
    joined digest until one is left. Sources are ordered by their UTF-8 bytes, null first; a null ``order`` value comes first;
    rows that tie are ordered by leaf. Repeated rows are leaves of their own. Without rows there is no root.
    Other columns, under whatever names, stay in ``leaves`` (tree, place, n, _at, _task, _first, _before, _here are taken).
    """
    # "" stands for a null source and sorts before "=" and its text
    named = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    leaves = cut(in_order(named, "tree", order, leaf))
    below = climb(leaves.withColumn("digest", F.col(leaf)), height)
    tops = below.levels[-1].select(F.lit("").alias("one"), "tree", "digest")
    tops = cut(in_order(tops, "one", "tree"))
    above = climb(tops.select(F.lit("").alias("tree"), "place", "n", "digest"), height)
    found = above.levels[-1].select("digest").first()
    subroots = tops.select(F.when(F.col("tree") != "", F.substring("tree", 2, 2147483647)).alias("source"), "tree", "digest", "place")
    return Manifest(leaves, subroots, found and found[0], below, above)


def proofs(book: Manifest, claim: str, leaf: str = "leaf") -> DataFrame:
    """The leaves with subroot, root, proof_sha256 and folded_root: the root that the column ``claim`` and the leaf's proof lead to.

    Folding uses the claimed digest and the siblings of the proof, never the stored root, so a claim other than the leaf shows.
    """
    start = book.subroots.sparkSession.createDataFrame([("", "", "")], "tree string, proof string, top string").limit(1 if book.root else 0)
    above = descend(book.above, start).select("place", "proof")
    heads = book.subroots.join(above, "place").select("tree", "proof", F.col("digest").alias("top"))
    claimed = book.leaves.select("tree", "place", "n", F.col(leaf).alias("digest"), F.col(claim).alias("claim"))
    below = Tree([claimed, *book.below.levels[1:]], book.below.height)
    found = descend(below, heads, folds=True)
    found = found.select("tree", "place", F.col("top").alias("subroot"), F.lit(book.root).cast("string").alias("root"), "proof_sha256", F.col("folded").alias("folded_root"))
    return book.leaves.join(found, ["tree", "place"])
