"""Exact comparison of the members of inverted lists, in cells of bounded size.

What a first, linear pass has joined is not compared again: only lists whose members lie in different components are, and a
cell gives back no more than one link for each two components, so a large group of near copies costs no row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import cut, shingle_sets

#: Members of a list in one block; two blocks are compared in one piece of work.
BLOCK = 1024
#: Two members whose sketches share a smaller part of their union are not compared. At a true 0.8 a part of 48 values has a
#: deviation of 0.058, so no link is lost here that the inverted lists find.
LEAST_SHARED = 0.4


def text_sets(cell: pa.Table, size: int) -> list[np.ndarray]:
    """Shingle sets of the column text."""
    return list(shingle_sets(cell["text"].combine_chunks(), size))


def stored_sets(cell: pa.Table) -> list[np.ndarray]:
    """Shingle sets of the column shingles, 64-bit hashes in order."""
    return [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]


def mixed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """What is left to compare of the lists (value, rep, n) after their smallest members met all others.

    The other members of the lists in which these are not known to be joined, with component and size. Known are the smallest
    neighbour and its smallest neighbour, which is enough for groups around one hub; what this misses is compared again.
    """
    met = lists.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 2").drop("members")
    left = lists.join(met, "value").filter("rep <> hub")
    low = cut(links.groupBy(F.greatest("a", "b").alias("rep")).agg(F.min(F.least("a", "b")).alias("near")).filter("rep <> near"))
    two = low.join(low.select(F.col("rep").alias("near"), F.col("near").alias("far")), "near", "left").select("rep", F.coalesce("far", "near").alias("component"))
    placed = left.join(two, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high")
    return placed.join(apart.select("value", "size"), "value").select("value", "rep", "n", "component", "size")


def meeting_again(lists: DataFrame, percent: int) -> DataFrame:
    """(cell, rep, component, home): cells in which members of mixed lists meet, all pairs of a list whose sizes allow a link.

    Each member is labelled with the smallest member of all its lists. The lists that lie inside one label form a group, which
    meets as a whole, each pair once, where that takes fewer pairs than its lists one by one (near copies share many lists);
    other lists meet by themselves. Either way members are dealt into bands of sizes, of which equal and adjacent ones
    meet, and bands into blocks; two blocks (or one) are a cell, so no cell grows with a group. Members of one block have one
    home and meet each other in the cell of that block alone.
    """
    lists = cut(lists)
    least = lists.groupBy("value").agg(F.min("rep").alias("least"))
    labels = lists.join(least, "value").groupBy("rep").agg(F.min("least").alias("label"))
    labelled = cut(lists.join(labels, "rep"))
    inside = labelled.groupBy("value").agg(F.min("label").alias("group"), F.max("label").alias("other"), F.first("size").cast("double").alias("size")).filter("group = other")
    by_list = inside.groupBy("group").agg(F.sum(F.col("size") ** 2).alias("by_list"))
    whole = labelled.join(inside.select("value", "group"), "value").select("group", "rep").distinct().groupBy("group").agg(F.count("*").cast("double").alias("members"))
    as_groups = whole.join(by_list, "group").filter(F.col("members") ** 2 <= F.col("by_list")).select("group")
    met = labelled.join(inside.select("value", "group").join(as_groups, "group"), "value", "left").withColumn("as_group", F.col("group").isNotNull())
    together = F.coalesce("group", "value")
    key = F.struct("as_group", together.alias("of"))
    met = met.select(key.alias("key"), "rep", "n", "component").distinct()
    met = met.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent + 1e-9))).cast("int"))
    sizes = met.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = met.join(sizes, ["key", "band"])
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    below = sizes.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    above = sizes.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    met = met.join(below, ["key", "band"], "left").join(above, ["key", "band"], "left")
    cell = lambda band, other, low, high: f"struct({band} as band, {other} as other, {low} as low, {high} as high)"
    own = f"transform(sequence(0, blocks - 1), x -> {cell('band', 'band', 'least(x, block)', 'greatest(x, block)')})"
    down = f"if(blocks_below is null, array(), transform(sequence(0, blocks_below - 1), x -> {cell('band - 1', 'band', 'x', 'block')}))"
    up = f"if(blocks_above is null, array(), transform(sequence(0, blocks_above - 1), x -> {cell('band', 'band + 1', 'block', 'x')}))"
    cells = F.expr(f"concat({own}, {down}, {up})")
    met = met.select("key", "rep", "component", F.struct("band", "block").alias("home"), F.explode(cells).alias("cell"))
    return met.select(F.xxhash64("key", "cell").alias("cell"), "rep", "component", F.xxhash64("home").alias("home"))


def marks_of(sketch: str) -> Column:
    """A sketch in a quarter of its bytes: 16 bits of each value, which are equal where the values are."""
    return F.transform(sketch, lambda x: F.shiftright(F.shiftleft(x, 48), 48).cast("smallint"))


def may_link(marks_a: str, marks_b: str, k: int) -> Column:
    """Whether the marks of two sketches of up to ``k`` values share enough."""
    shared = F.size(F.array_intersect(marks_a, marks_b))
    return shared >= LEAST_SHARED * F.least(F.lit(k), F.size(marks_a) + F.size(marks_b) - shared)


def with_partners(cells: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """The members of cells (cell, rep, component, home) whose marks (rep, marks) are like those of another one that they meet.

    Most members of a mixed list share a common value with the others and nothing else; their texts need not move.
    """
    marked = cells.join(marks, "rep").select("cell", "rep", "component", "home", "marks").repartition("cell").sortWithinPartitions("cell")
    return marked.mapInArrow(partial(_partners, k=k), "cell long, rep long, component long, home long")


def _partners(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Most cells are small and keep nothing, so those of a batch go through as arrays and come back as one."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cells = batch["cell"].to_numpy()
        last = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
        if last or (waiting and waiting[-1]["cell"][0].as_py() != cells[0]):
            yield from _likely([*waiting, batch.slice(0, last)], k)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield from _likely(waiting, k)


def _likely(parts: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """Of whole cells the members that have a likely partner."""
    cells = pa.Table.from_batches(parts).combine_chunks()
    cell, component, home = (cells[c].to_numpy() for c in ("cell", "component", "home"))
    marks = cells["marks"].combine_chunks()
    counts, values = marks.value_lengths().to_numpy(), marks.flatten().to_numpy()
    ends = np.concatenate(([0], np.cumsum(counts)))
    bounds = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    kept = np.zeros(len(cell), dtype=bool)
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        apart = _apart(component[x:y], home[x:y])
        if apart.any():
            n = counts[x:y]
            same = _shared(values[ends[x] : ends[y]], n)
            kept[x:y] = (apart & (same >= LEAST_SHARED * np.minimum(k, n[:, None] + n[None, :] - same))).any(axis=1)
    return cells.select(["cell", "rep", "component", "home"]).filter(pa.array(kept)).to_batches() if kept.any() else []


def verify_cells(batches: Iterator[pa.RecordBatch], sets: Callable[[pa.Table], list[np.ndarray]], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each cell the linked pairs that lie in different components, one for each two components."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch["cell"].to_numpy()
        bounds = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(batch)]
        for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if x == y:
                continue
            part, this = batch.slice(x, y - x), cells[x]
            if waiting and (i or waiting[0][0] != this):
                yield _of_cell([p for _, p in waiting], sets, percent)
                waiting = []
            waiting.append((this, part))
    if waiting:
        yield _of_cell([p for _, p in waiting], sets, percent)


def _apart(component: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Which two members of a cell meet: those of different components, in a cell of two blocks those of different ones."""
    apart = component[:, None] != component[None, :]
    if (home != home[0]).any():
        apart &= home[:, None] != home[None, :]
    return apart


def _shared(members: np.ndarray, counts: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values each two sets share; ``members``: the values of all sets, one after the other."""
    _, place, times = np.unique(members, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(counts)), counts)
    shared = times[place] > 1
    column, row = (np.cumsum(times > 1) - 1)[place[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    same = np.zeros((len(counts), len(counts)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (start, start + width))
        met = np.zeros((len(counts), width), np.float32)
        met[row[x:y], column[x:y] - start] = 1
        same += met @ met.T
    return same


def _of_cell(parts: list[pa.RecordBatch], sets_of: Callable[[pa.Table], list[np.ndarray]], percent: int) -> pa.RecordBatch:
    cell = pa.Table.from_batches(parts)
    rep, component, home = (cell[c].to_numpy() for c in ("rep", "component", "home"))
    found_a, found_b = rep[:0], rep[:0]
    apart = _apart(component, home)
    if apart.any():
        sets = sets_of(cell)
        counts = np.array([len(x) for x in sets])
        same = _shared(np.concatenate(sets), counts)
        union = counts[:, None] + counts[None, :] - same
        i, j = np.nonzero(np.triu(apart & (100 * same.astype(np.int64) >= percent * union.astype(np.int64)), 1))
        ends = np.sort(np.stack([component[i], component[j]], 1), axis=1)
        _, one = np.unique(ends, axis=0, return_index=True)
        found_a, found_b = rep[i[one]], rep[j[one]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(found_a, found_b)), pa.array(np.maximum(found_a, found_b))], names=["a", "b"])
