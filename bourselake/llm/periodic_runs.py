"""Periodic runs by grammar compression: Re-Pair over word ids, each rule searched once at its boundary.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one. Here each round replaces, all at once, every pair
that is the most frequent one of its neighbourhood, over all documents of a batch together. When no pair occurs twice, what is
left of each text is paired off evenly, so that every text ends as one symbol. A run that a rule X -> Y Z contains and neither Y
nor Z does crosses the boundary of Y and Z. It is searched for in one place where X stands, then carried over to all places at
which X was derived; intervals of one period that overlap by a period or more are merged. Every run is found at the lowest rule
that contains it, with its true ends.

Within a run of four periods each pair of neighbouring words occurs three times in the document, so pairs that occur less
often get no rule and cut the text into segments which no run leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import BYTE_AS_IS, mix, span_hashes, text_slices, word_bounds

#: A run has so many words or more, and so many times its period.
LEAST_WORDS = 6
LEAST_EXPONENT = 4

_MANY = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_MANY), -1, 2**64))
_NONE = np.zeros((0, 3), np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number from 0) of each of ``counts[i]`` items of the owners i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _segments(words: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretches in which each pair of neighbours occurs ``times`` times in its text or more."""
    n = len(words)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = mix((words[:-1] * _MANY + words[1:]) ^ mix(text[1:].astype(np.uint64) + _MANY))
    _, place, count = np.unique(pairs, return_inverse=True, return_counts=True)
    alive = (count[place] >= times) & (text[1:] == text[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2] + 1
    long = end - start >= least
    return start[long], end[long]


def _right_runs(ids: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (rule, from, to, period) of runs of rules [start, middle, end) that cross the middle and have half their length or more right of it."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(ids) + 1, _MANY, dtype=np.uint64))
        back = np.cumprod(np.full(len(ids) + 1, _BACK, dtype=np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + _MANY) * power[:-1])))
        rule, period = _spread(2 * (end - middle) // exponent)
        period = period + 1
        near = ids[middle[rule]] == ids[middle[rule] + period]
        rule, period = rule[near], period[near]
        # half the run is exponent / 2 periods, so what is left of that after one period repeats what came a period earlier
        same = (exponent * period + 1) // 2 - period
        at, other = middle[rule], middle[rule] + period
        alike = (total[at + same] - total[at]) * back[at] == (total[other + same] - total[other]) * back[other]
    rule, period, found = rule[alike], period[alike], []
    while len(rule):
        which, first = np.unique(rule, return_index=True)
        q, s, m, e = period[first], start[which], middle[which], end[which]
        owner, number = _spread(e - q - s)
        at = s[owner] + number
        differs = ids[at] != ids[at + q[owner]]
        after = np.where(differs & (at >= m[owner]), at, len(ids))
        before = np.where(differs & (at < m[owner]), at, -1)
        begins = np.cumsum(e - q - s) - (e - q - s)
        to = np.minimum(np.minimum.reduceat(after, begins) + q, e)
        since = np.maximum(np.maximum.reduceat(before, begins) + 1, s)
        good = (since < m) & (to > m) & (to - since >= np.maximum(least, exponent * q))
        found.append(np.stack((which[good], since[good], to[good], q[good]), 1))
        # a longer period inside what has period q is a multiple of it
        reach = np.zeros(len(start), np.int64)
        reach[which] = to - m
        left = (2 * period > reach[rule]) & (period > np.bincount(which, q, len(start)).astype(np.int64)[rule])
        rule, period = rule[left], period[left]
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _crossing(ids: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (rule, from, to, period), relative to the rule's start, of all runs that cross the middle."""
    n = len(ids)
    right = _right_runs(ids, start, middle, end, least, exponent)
    left = _right_runs(ids[::-1], n - end, n - middle, n - start, least, exponent)
    left = np.stack((left[:, 0], n - left[:, 2], n - left[:, 1], left[:, 3]), 1)
    both = np.unique(np.concatenate((right, left)), axis=0)
    both[:, 1:3] -= start[both[:, 0]][:, None]
    return both


def _chosen(key: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which pairs to replace in a round: the most frequent ones of their neighbourhood, of a repeated symbol's every second."""
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    many = np.bincount(place, joined).astype(np.uint64)[place]
    rank = np.where(joined & (many > 1), (many << np.uint64(40)) | (mix(key.astype(np.uint64)) >> np.uint64(24)), np.uint64(0))
    padded = np.concatenate(([np.uint64(0)], rank, [np.uint64(0)]))
    best = (rank > 0) & (rank >= padded[:-2]) & (rank >= padded[2:])
    begin = best & ~np.concatenate(([False], best[:-1]))
    since = np.arange(len(best)) - np.maximum.accumulate(np.where(begin, np.arange(len(best)), 0))
    return best & (since % 2 == 0)


def _merged(found: np.ndarray) -> np.ndarray:
    """Rows (from, to, period) with those of one period that overlap by a period or more made one."""
    found = found[np.lexsort((found[:, 0], found[:, 2]))]
    since, to, period = found.T
    fresh = np.concatenate(([True], period[1:] != period[:-1]))
    far = int(to.max()) + 1
    group = np.cumsum(fresh) * far
    reach = np.maximum.accumulate(to + group) - group
    fresh[1:] |= since[1:] + period[1:] > reach[:-1]
    begin = np.flatnonzero(fresh)
    return np.stack((since[begin], np.maximum.reduceat(to, begin), period[begin]), 1)


def grammar_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (from, to, period) of all runs, in order, of texts that have the word hashes ``words[first[i]:first[i + 1]]``."""
    begin, end = _segments(words, first, least, exponent - 1)
    if not len(begin):
        return _NONE
    segment, number = _spread(end - begin)
    place = begin[segment] + number  # of each word of the segments in the texts
    _, ids = np.unique(words[place], return_inverse=True)
    symbol, at, found = ids.astype(np.int64), np.arange(len(ids)), []
    fresh = int(symbol.max()) + 1
    frequent = True
    while len(symbol) > len(begin):
        joined = segment[1:] == segment[:-1]
        key = symbol[:-1] * np.int64(fresh) + symbol[1:]
        if frequent:
            take = _chosen(key, joined)
            frequent = bool(take.any())
        if not frequent:
            head = np.concatenate(([True], ~joined))
            since = np.arange(len(symbol)) - np.maximum.accumulate(np.where(head, np.arange(len(symbol)), 0))
            take = joined & (since[:-1] % 2 == 0)
        pair = np.flatnonzero(take)
        rules, one, rule = np.unique(key[pair], return_index=True, return_inverse=True)
        ends = np.append(at[1:], len(ids))
        start, middle, end = at[pair[one]], at[pair[one] + 1], ends[pair[one] + 1]
        long = np.flatnonzero(end - start >= least)
        runs = _crossing(ids, start[long], middle[long], end[long], least, exponent)
        if len(runs):
            order = np.argsort(rule, kind="stable")
            bounds = np.searchsorted(rule[order], np.arange(len(rules) + 1))
            runs[:, 0] = long[runs[:, 0]]
            low = bounds[runs[:, 0]]
            run, number = _spread(bounds[runs[:, 0] + 1] - low)
            derived = at[pair[order[low[run] + number]]]
            found.append(np.stack((derived + runs[run, 1], derived + runs[run, 2], runs[run, 3]), 1))
        symbol[pair] = fresh + rule
        fresh += len(rules)
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, at, segment = symbol[keep], at[keep], segment[keep]
        if fresh > 1 << 31:  # symbols are numbered anew before a pair of them outgrows 64 bits
            _, symbol = np.unique(symbol, return_inverse=True)
            fresh = int(symbol.max()) + 1
    if not found:
        return _NONE
    runs = _merged(np.concatenate(found))
    runs = np.stack((place[runs[:, 0]], place[runs[:, 1] - 1] + 1, runs[:, 2]), 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(batches: Iterator[pa.RecordBatch], least: int, exponent: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, columns = [], ([], [], [], [])
        for _, data, offsets in text_slices(batch["text"]):
            starts, ends, first = word_bounds(data, offsets)
            runs = grammar_runs(span_hashes(data, starts, ends, BYTE_AS_IS), first, least, exponent)
            owner = np.searchsorted(first, runs[:, 0], side="right") - 1
            columns[0].append(np.bincount(owner, minlength=len(first) - 1))
            for column, values in zip(columns[1:], (runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]), strict=True):
                column.append(values)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 1], -1)
            kept = np.cumsum(gone[:-1]) == 0
            size = np.where(kept, ends - starts + 1, 0)  # with the space after it
            word, number = _spread(size)
            source = starts[word] + number
            out = np.where(number == size[word] - 1, np.uint8(32), np.append(data, np.uint8(32))[source])
            reach = np.concatenate(([0], np.cumsum(size)))[first]
            whole = out.tobytes()
            texts.extend(whole[a : max(a, b - 1)].decode() for a, b in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True))
        if not len(batch):
            continue
        counts, *values = (np.concatenate(c).astype(np.int64) for c in columns)
        bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(v) for v in values], names=["start", "length", "period"])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.ListArray.from_arrays(bounds, spans), pa.array(texts, pa.string())], names=[*keep, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with runs (structs of start, length, period in words, by start, then period) and collapsed.

    A run is a stretch of words (ended by ASCII white space) with smallest period q, of ``least`` words and ``exponent`` (4 or more) times q or more,
    that no neighbouring word extends. collapsed holds the words that no run contains after its first q ones, joined by one
    space. A null, empty or blank text has no run and an empty collapsed; rows that repeat stay; ``keep`` may name any columns
    but runs and collapsed. A document is the unit of memory. Words are compared as 64-bit hashes.
    """
    if exponent < 4:
        raise ValueError("half of a run must hold two of its periods")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(partial(_collapse, least=least, exponent=exponent, keep=list(keep)), schema)


def words_of(text: Column) -> Column:
    """The words of a text column as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
