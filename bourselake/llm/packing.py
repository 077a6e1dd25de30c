"""Conflict-constrained best-fit packing of documents into training sequences.

Open bins are ordered by what room they have left. Each carries a bitmap of the sources and one of the duplicate clusters
inside it. A document, longest first, goes to the tightest bin that has room and whose bitmaps do not hold its source or
its cluster; the search moves to the next larger room until such a bin is found, and opens a bin if there is none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import cut, text_slices, word_bounds
from bourselake.llm.near_dedup import near_duplicates

#: Length of a bin.
CAPACITY = 2048
#: Documents that are packed together, at most; bins do not reach across.
TOGETHER = 8192
#: Groups are dealt by hash, of such a share of TOGETHER on average that hardly any grows beyond it.
FILL = 0.9

SCHEMA = "doc_id long, part int, start long, length long, bin_id long, bin_start long"


def pack(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, place in the bin) for items (length, source, cluster); null sources and clusters conflict with nothing.

    An item longer than a bin fills whole bins of its own; only its rest is fitted. An item of length 0 takes no room.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin) of the open bins, in order
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    pieces = []
    for i, (length, source, cluster) in enumerate(items):
        whole = length // capacity if length > capacity else 0
        for j in range(whole):
            placed.append((i, j * capacity, capacity, len(used), 0))
            used.append(capacity)
            sources.append(-1)
            clusters.append(-1)
        if length - whole * capacity or not whole:
            pieces.append((-(length - whole * capacity), i, whole * capacity, 0 if source is None else 1 << source, 0 if cluster is None else 1 << cluster))
    pieces.sort()
    for less, i, start, source, cluster in pieces:
        length = -less
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & source or clusters[rooms[at][1]] & cluster):
            at += 1
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            room, bin_ = capacity, len(used)
            used.append(0)
            sources.append(0)
            clusters.append(0)
        placed.append((i, start, length, bin_, used[bin_]))
        used[bin_] += length
        sources[bin_] |= source
        clusters[bin_] |= cluster
        if room - length:
            insort(rooms, (room - length, bin_))
    return placed


def _number(values: pd.Series) -> list[int | None]:
    codes, _ = pd.factorize(values)
    return [None if c < 0 else int(c) for c in codes]


def _pack(frames: Iterator[pd.DataFrame], capacity: int, together: int) -> Iterator[pd.DataFrame]:
    """Frames of rows in the order of their groups; one larger than ``together`` is packed in parts."""
    group, bins = None, 0
    waiting: list[pd.DataFrame] = []

    def packed() -> pd.DataFrame:
        nonlocal bins
        rows = pd.concat(waiting, ignore_index=True)
        waiting.clear()
        placed = pack(list(zip(rows["length"].astype(int), _number(rows["source"]), _number(rows["cluster"]), strict=True)), capacity)
        out = pd.DataFrame(placed, columns=["item", "start", "length", "bin_id", "bin_start"])
        out["doc_id"] = rows["doc_id"].to_numpy()[out["item"]]
        out["part"] = (out["start"] // capacity).astype("int32")
        used = int(out["bin_id"].max()) + 1
        out["bin_id"] += (group << 36) + bins
        bins += used
        return out[[c.split()[0] for c in SCHEMA.split(", ")]]

    for frame in frames:
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        for number, rows in frame.groupby("group", sort=False):
            if number != group:
                if waiting:
                    yield packed()
                group, bins = int(number), 0
            while len(rows):
                room = together - sum(map(len, waiting))
                waiting.append(rows.iloc[:room])
                rows = rows.iloc[room:]
                if sum(map(len, waiting)) == together:
                    yield packed()
    if waiting:
        yield packed()


def n_words(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+")))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.diff(word_bounds(data, offsets)[2]) for _, data, offsets in text_slices(batch["text"])]
        counts = pa.array(np.concatenate(words) if words else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, batch["source"], batch["same"], batch["text"].is_valid()], names=["doc_id", "words", "source", "same", "has_text"])


def clustered(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, words, source, text, same, cluster) of every row of ``docs``, for best_fit: the near-duplicate components as clusters.

    A row without doc_id is in the component of an equal text. Texts without words, which are near to nothing, and texts that
    no row with doc_id has, are in one cluster with equal texts. Of ``text`` only whether it is null is kept, of its content the hash same.
    """
    text = F.col("text").cast("string")
    same = F.concat_ws(" ", F.xxhash64(text), F.xxhash64(F.lit(1), text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), same.alias("same"), text.alias("text"))
    rows = cut(rows.mapInArrow(_measure, "doc_id long, words long, source string, same string, has_text boolean"))
    labels = near_duplicates(docs, size, percent).filter("doc_id is not null").select("doc_id", "component_id").distinct()
    numbered = rows.filter("doc_id is not null").join(labels, "doc_id", "left").withColumn("component", F.when(F.col("words") > 0, F.col("component_id"))).drop("component_id")
    others = rows.filter("doc_id is null")
    known = numbered.join(others.select("same").distinct(), "same", "left_semi").groupBy("same").agg(F.min("component").alias("component"))
    both = numbered.unionByName(others.join(known, "same", "left"))
    return both.select("doc_id", "words", "source", F.when(F.col("has_text"), "").alias("text"), "same", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("same "), "same")).alias("cluster"))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, together: int = TOGETHER, length: Column | None = None, cluster: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Rows (doc_id, part, start, length, bin_id, bin_start): where each piece of each document lies.

    ``length`` defaults to the words of ``text``, null counts as 0; ``cluster`` to equal texts, so no bin holds two documents of a source or two
    copies of a text. Every row of ``docs`` is packed, repeated rows as often as they occur; an empty or null text is one
    piece of length 0; a null source conflicts with nothing. Documents are dealt by a hash of doc_id and ``tie``, which is what else tells rows
    apart (the text's hash by default), into groups of ``together`` at most, and bins are made inside a group, so no task holds
    more, what a hot source costs is bounded, and the same rows give the same bins however they are partitioned.
    """
    length = n_words(F.col("text")) if length is None else length
    cluster = F.xxhash64("text") if cluster is None else cluster
    tie = F.xxhash64("text") if tie is None else tie
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(length.cast("long"), F.lit(0)).alias("length"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col("text").isNotNull(), cluster.cast("string")).alias("cluster"),
        tie.cast("string").alias("tie"),
    )
    items = cut(items)
    groups = -(-items.count() // max(1, int(FILL * together))) or 1
    items = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(groups)))
    items = items.repartition("group").sortWithinPartitions("group", "doc_id", "tie", "source", "cluster", "length")
    return items.select("group", "doc_id", "length", "source", "cluster").mapInPandas(partial(_pack, capacity=capacity, together=together), SCHEMA)
