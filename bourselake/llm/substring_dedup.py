"""Repeated paragraphs and passages: paragraph MinHash banding, exact verification, removals by component.

A paragraph is a line, the lines between two blank ones, or short lines one after another, as hard-wrapped text has them.
Paragraphs meet when a band of their MinHash agrees and are verified by exact Jaccard. So that a passage put into the middle
of a paragraph is found too, texts are also cut at points that depend on nothing but the few words around them, and the window
of LEAST_WORDS words from each of them, an anchor, is listed with what surrounds it. Where an anchor and its surroundings
are those of the anchor's first document, they are repeated as a whole; only where a text parts from that document are all
windows near the anchor compared, so a passage goes from its first word to its last. The first document of a component, an
anchor or a window keeps it. Lists are sorted by value and read as a stream, so a value that all documents share costs no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.cells import meeting_again, mixed, stored_sets, verify_cells
from bourselake.llm.common import components, discard, mix, shingle_hashes, span_hashes, stored, text_slices, word_bounds

#: Bands and rows: a pair at Jaccard 0.8 meets with probability 1 - (1 - 0.8^3)^8 = 0.997, at 0.9 with 1 - 3e-5.
BANDS, ROWS = 8, 3
#: A line counts with this many words or more, and so does a repeated passage.
LEAST_WORDS = 20
#: Each window of so many word pairs has a cut point, so a repeated passage of LEAST_WORDS + WINDOW + 1 words or more has an anchor,
#: and reaches less than WINDOW + 2 words beyond its first and last one.
WINDOW = 15
#: What is known of an anchor in a document: that it stands in an earlier one; that so do the words from it to the end of the next
#: anchor, and those from the last cut before it; that windows right of it, and left of it, are to be compared.
LATER, RIGHT, LEFT, ASK_RIGHT, ASK_LEFT = 1, 2, 4, 8, 16

_LOW, _HIGH = np.uint64(2**32 - 1), np.uint64(2**64 - 2**32)

_SEEDS = np.random.default_rng(8).integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MANY = np.uint64(0x9E3779B97F4A7C15)


def _sliding(values: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``window`` consecutive values."""
    width = 1
    while width < window:
        step = min(width, window - width)
        values = pick(values[: len(values) - step], values[step:])
        width += step
    return values


def cut_points(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where pieces start: before word 0 and after each word pair whose hash is the least of a window of pairs."""
    if len(words) < window + 1:
        return np.zeros(1, np.int64)
    pairs = shingle_hashes(words, 2)
    least = _sliding(pairs, window, np.minimum)
    padded = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
    chosen = _sliding(padded, window, np.maximum) == pairs
    chosen[1:] &= pairs[1:] != pairs[:-1]  # in a run of one repeated word only its start is a cut
    return np.concatenate((np.zeros(1, np.int64), np.flatnonzero(chosen) + 1))


def _of_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """A hash of the words from each start to its end, or else to the next start."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(words) + 1, _MANY, dtype=np.uint64))
        back = np.cumprod(np.full(len(words) + 1, np.uint64(pow(int(_MANY), -1, 2**64)), dtype=np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])))
        ends = np.append(starts[1:], len(words)) if ends is None else ends
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(place, end of the next anchor or of the text, cut before it, hash, hash of the surroundings) of each anchor, in order."""
    begin = cut_points(words)
    at = begin[begin + least <= len(words)]
    if not len(at):
        return at, at, at, words[:0], words[:0]
    end, since = np.append(at[1:] + least, len(words)), np.concatenate((np.zeros(1, np.int64), at[:-1]))
    anchor, right, left = np.split(_of_runs(words, np.concatenate((at, at, since)), np.concatenate((at + least, end, at + least))), 3)
    return at, end, since, anchor, (left & _HIGH) | (right >> np.uint64(32))


def _list_anchors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_slices(batch["text"]):
            starts, ends, first = word_bounds(data, offsets)
            words = span_hashes(data, starts, ends)
            ids, found, around = batch["doc_id"].slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False), [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                *_, anchor, beside = _anchors(words[a:b], least)
                _, one = np.unique(anchor ^ mix(beside), return_index=True)
                found.append(anchor[one])
                around.append(beside[one])
            columns = [np.repeat(ids, [len(x) for x in found]), np.concatenate(found).view(np.int64), np.concatenate(around).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "anchor", "around"])


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, tuple[np.ndarray, ...]]]:
    """(columns, first, columns of the first row of each row's value) of rows sorted by their first column, over batches."""
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = tuple(batch[c].to_numpy() for c in names)
        fresh = np.concatenate(([True], columns[0][1:] != columns[0][:-1]))
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        heads = [c[begin] for c in columns]
        if last is not None and last[0] == columns[0][0]:
            going_on = begin == 0
            fresh[0] = False
            for head, value in zip(heads, last, strict=True):
                head[going_on] = value
        last = tuple(h[-1] for h in heads)
        yield columns, fresh, tuple(heads)


def _met_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc_id, around), sorted, to what is known of the anchor in each document; nothing of those in one document only."""
    for (anchor, doc, around), _, (_, first, beside) in _groups(batches, ("anchor", "doc_id", "around")):
        later = np.flatnonzero(doc != first)
        differs = (around[later] ^ beside[later]).view(np.uint64)
        right, left = (differs & _LOW) == 0, (differs & _HIGH) == 0
        known = LATER + np.where(right, RIGHT, ASK_RIGHT) + np.where(left, LEFT, ASK_LEFT)
        # the first document is asked where another one parts from it
        asked = later[~(right & left)]
        firsts = np.unique(np.stack((anchor[asked], first[asked], beside[asked])), axis=1)
        columns = [np.concatenate(x) for x in ((firsts[1], doc[later]), (firsts[0], anchor[later]), (firsts[2], around[later]))]
        known = np.concatenate((np.full(firsts.shape[1], ASK_RIGHT + ASK_LEFT), known))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(known, pa.int32())], names=["doc_id", "anchor", "around", "known"])


def _met_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (window, doc_id), sorted, those whose window an earlier document has."""
    for (window, doc), _, (_, first) in _groups(batches, ("window", "doc_id")):
        later = np.flatnonzero(doc != first)
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(window[later])], names=["doc_id", "window"])


def _met_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, line), sorted, of the lists with several lines, each line once: (value, rep, a), where a is the list's first."""
    for (value, line), fresh, (_, first) in _groups(batches, ("value", "line")):
        again = np.concatenate(([False], (value[1:] == value[:-1]) & (line[1:] == line[:-1])))
        other = np.flatnonzero((line != first) & ~again)
        # of a list that goes on in the next batch the first line is given twice; distinct() follows
        heads = np.unique(np.stack((value[other], first[other])), axis=1)
        columns = [np.concatenate(x) for x in ((heads[0], value[other]), (heads[1], line[other]), (heads[1], first[other]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["value", "rep", "a"])


def _windows_of(words: np.ndarray, least: int) -> np.ndarray:
    """A hash of each ``least`` consecutive words."""
    starts = np.arange(max(len(words) - least + 1, 0))
    return _of_runs(words, starts, starts + least)


def _asked(words: np.ndarray, hashes: list[int], known: list[int], least: int) -> np.ndarray:
    """The places of the windows that a passage can hold which reaches beyond the anchors with these hashes.

    One word over and over has no cut point inside, so distance counts changes of the word.
    """
    at, _, _, anchor, _ = _anchors(words, least)
    wanted = {}
    for h, k in zip(hashes, known, strict=True):
        wanted[h] = wanted.get(h, 0) | k
    change = np.concatenate((np.zeros(1, np.int64), np.cumsum(words[1:] != words[:-1])))
    steps = np.zeros(len(words) + 1, np.int64)
    place = {h: [] for h in wanted}
    for i in np.flatnonzero(np.isin(anchor.view(np.int64), np.array(list(wanted), np.int64))).tolist():
        place[int(anchor[i : i + 1].view(np.int64)[0])].append(int(at[i]))
    for h, places in place.items():
        for c in places:
            low = np.searchsorted(change, change[c] - WINDOW - 2) if wanted[h] & ASK_LEFT else c
            high = np.searchsorted(change, change[c] + WINDOW + 2, side="right") if wanted[h] & ASK_RIGHT else c
            steps[low] += 1
            steps[high] -= 1
    return np.flatnonzero(np.cumsum(steps)[: len(words) - least + 1] > 0)


def _units(number: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the paragraphs of ``least`` words or more, from each word's line number.

    These are the lines, the lines between two blank ones, and consecutive lines that are too short by themselves.
    """
    step = np.diff(number)
    begin = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(step) + 1))
    blank = np.concatenate(([True], step[begin[1:] - 1] > 1))
    end = np.append(begin[1:], len(number))
    short = end - begin < least
    spans = [(begin, end)]
    for starts in (blank, blank | ~short | np.concatenate(([True], ~short[:-1]))):
        if starts.sum() > 1 or starts is not blank:
            first = np.flatnonzero(starts)
            last = np.append(first[1:], len(begin)) - 1
            several = last > first
            spans.append((begin[first[several]], end[last[several]]))
    begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    long = end - begin >= least
    return begin[long], end[long]


def _text_lines(column: pa.Array, least: int, size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(hash, shingle hashes) of each paragraph of ``least`` words or more, for each row."""
    for _, data, offsets in text_slices(column):
        starts, ends, first = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends)
        number = np.cumsum(data == 10)[starts] if len(starts) else starts
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a < least:
                yield []
                continue
            begin, end = _units(number[a:b], least)
            if not len(begin):
                yield []
                continue
            hashes, shingles = _of_runs(words[a:b], begin, end).view(np.int64), shingle_hashes(words[a:b], size)
            yield [(h, shingles[x : y - size + 1]) for h, x, y in zip(hashes.tolist(), begin.tolist(), end.tolist(), strict=True)]


def _bands(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    place = np.arange(BANDS, dtype=np.uint64)[:, None]
    for batch in batches:
        docs = batch["doc_id"].to_pylist()
        waiting, shingles_waiting = [], 0
        for row, lines in enumerate(_text_lines(batch["text"], least, size), 1):
            for line, found in dict(lines).items():
                waiting.append((docs[row - 1], line, found))
                shingles_waiting += len(found)
            if waiting and (shingles_waiting > 200_000 or row == len(docs)):
                starts = np.concatenate(([0], np.cumsum([len(f) for _, _, f in waiting])[:-1]))
                every = np.concatenate([f for _, _, f in waiting])
                signature = np.stack([np.minimum.reduceat(every * seed, starts) for seed in _SEEDS]).reshape(BANDS, ROWS, -1)
                key = np.broadcast_to(place, (BANDS, len(waiting))).copy()
                for i in range(ROWS):
                    key = mix(key * _MANY + signature[:, i])
                keys = pa.array(np.ascontiguousarray(key.T).ravel().view(np.int64))
                lists = pa.FixedSizeListArray.from_arrays(keys, BANDS).cast(pa.list_(pa.int64()))
                columns = [pa.array([d for d, _, _ in waiting], pa.int64()), pa.array([h for _, h, _ in waiting], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "bands"])
                waiting, shingles_waiting = [], 0


def _wanted(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """(line, shingles) of the lines asked for of each text and (doc_id, windows) of the windows near the anchors asked for."""
    for batch in batches:
        out_lines, sets = [], []
        for wanted, lines in zip(batch["wanted"].to_pylist(), _text_lines(batch["text"], least, size), strict=True):
            wanted = set(wanted or ())
            for line, found in lines if wanted else ():
                if line in wanted:
                    wanted.discard(line)
                    out_lines.append(line)
                    sets.append(np.unique(found).tobytes())
        docs, windows = [], []
        for row, data, offsets in text_slices(batch["text"]):
            part = batch.slice(row, len(offsets) - 1)
            asked = part["asked"].to_pylist()
            if not any(asked):
                continue
            starts, ends, first = word_bounds(data, offsets)
            words = span_hashes(data, starts, ends)
            for i, doc in enumerate(part["doc_id"].to_pylist()):
                own = words[first[i] : first[i + 1]]
                if asked[i] and len(own) >= least:
                    at = _asked(own, [x["anchor"] for x in asked[i]], [x["known"] for x in asked[i]], least)
                    docs.append(doc)
                    windows.append(np.unique(_of_runs(own, at, at + least)).view(np.int64))
        n, m = len(out_lines), len(docs)
        columns = [pa.array(out_lines + [None] * m, pa.int64()), pa.array(sets + [None] * m, pa.binary()), pa.array([None] * n + docs, pa.int64()), pa.array([None] * n + windows, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["line", "shingles", "doc_id", "windows"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True):
            both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
            same = int((both[1:] == both[:-1]).sum())
            good.append(100 * same >= percent * (len(both) - same))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _rewrite(batches: Iterator[pa.RecordBatch], least: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for row, data, offsets in text_slices(batch["text"]):
            starts, ends, first = word_bounds(data, offsets)
            words = span_hashes(data, starts, ends)
            breaks = np.cumsum(data == 10)
            count = len(offsets) - 1
            lines, windows, anchors = (batch[c].slice(row, count).to_pylist() for c in ("_lines", "_windows", "_anchors"))
            whole = batch["text"].slice(row, count).to_pylist()
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if not (lines[i] or windows[i] or anchors[i]):
                    texts.append(whole[i])
                    spans.append([])
                    continue
                gone = np.zeros(b - a + 1, dtype=bool)
                own = words[a:b]
                if windows[i]:
                    at = np.flatnonzero(np.isin(_windows_of(own, least), np.array(windows[i], np.int64).view(np.uint64)))
                    steps = np.zeros(b - a + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + least, -1)
                    gone = np.cumsum(steps) > 0
                if anchors[i]:
                    known = {(x["hash"], x["around"]): x["known"] for x in anchors[i]}
                    at, end, since, anchor, around = _anchors(own, least)
                    keys = zip(anchor.view(np.int64).tolist(), around.view(np.int64).tolist(), strict=True)
                    for x, y, z, key in zip(at.tolist(), end.tolist(), since.tolist(), keys, strict=True):
                        if k := known.get(key, 0):
                            gone[z if k & LEFT else x : y if k & RIGHT else x + least] = True
                if lines[i]:
                    begin, end = _units(breaks[starts[a:b]], least)
                    repeated = np.isin(_of_runs(own, begin, end), np.array(lines[i], np.int64).view(np.uint64))
                    for x, y in zip(begin[repeated].tolist(), end[repeated].tolist(), strict=True):
                        gone[x:y] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)))
                text, at, out = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                cuts = [(int(starts[a + x] - offsets[i]), int(ends[a + y - 1] - offsets[i])) for x, y in zip(edges[::2], edges[1::2], strict=True)]
                points = []
                for x, y in cuts:
                    out.append(text[at:x])
                    points.append([len(text[:x].decode()), len(text[:y].decode())])
                    at = y
                texts.append(b"".join([*out, text[at:]]).decode())
                spans.append(points)
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in keep), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*keep, "cleaned", "removed"]
        )


#: What is to be removed of a document: hashes of lines, of windows, and of anchors with their surroundings and what is known of them.
LINE, SPAN, ANCHOR = 0, 1, 2


def repeated_paragraphs(docs: DataFrame, least: int = LEAST_WORDS, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, kind, hash, around, known): lines, windows and anchors of ``least`` words that an earlier document has already.

    Lines, and paragraphs of several lines, of ``least`` words or more (``least`` is at least ``size``) whose ``size``-word shingle sets have a Jaccard of ``percent`` hundredths or more are
    linked; each component is kept in its smallest doc_id. Every pair that shares a band is verified or lies in one component
    already: in each band's list all members meet the smallest one, and if they then lie in several components, each other
    in cells of bounded size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    listed = docs.mapInArrow(partial(_list_anchors, least=least), "doc_id long, anchor long, around long")
    listed = listed.select("anchor", "doc_id", "around").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "around")
    anchors = stored(listed.mapInArrow(_met_anchors, "doc_id long, anchor long, around long, known int"))

    banded = stored(docs.mapInArrow(partial(_bands, least=least, size=size), "doc_id long, line long, bands array<long>"))
    lists = banded.select(F.explode("bands").alias("value"), "line").repartition("value").sortWithinPartitions("value", "line")
    lists = stored(lists.mapInArrow(_met_lines, "value long, rep long, a long").distinct())
    where = banded.select("doc_id", F.col("line").alias("rep")).join(lists.select("rep").distinct(), "rep").groupBy("rep").agg(F.min("doc_id").alias("doc_id"))
    where = where.groupBy("doc_id").agg(F.collect_list("rep").alias("wanted"))
    asked = anchors.filter(F.col("known") >= ASK_RIGHT).groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "known")).alias("asked"))
    both = where.join(asked, "doc_id", "full")
    read = stored(docs.join(both, "doc_id").mapInArrow(partial(_wanted, least=least, size=size), "line long, shingles binary, doc_id long, windows array<long>"))
    sets = stored(read.filter("line is not null").select("line", "shingles").dropDuplicates(["line"]))
    windows = read.select("doc_id", F.explode("windows").alias("window")).select("window", "doc_id").repartition("window").sortWithinPartitions("window", "doc_id")
    windows = stored(windows.mapInArrow(_met_windows, "doc_id long, window long").distinct())
    discard(read)

    spokes = lists.filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    sided = spokes.join(sets.select(F.col("line").alias("a"), F.col("shingles").alias("set_a")), "a")
    sided = sided.join(sets.select(F.col("line").alias("b"), F.col("shingles").alias("set_b")), "b")
    first = stored(sided.select("a", "b", "set_a", "set_b").mapInArrow(partial(_verify, percent=percent), "a long, b long"))
    sizes = sets.select(F.col("line").alias("rep"), (F.length("shingles") / 8).cast("long").alias("n"))
    again = meeting_again(mixed(lists.select("value", "rep").join(sizes, "rep"), first), percent)
    cells = again.join(sets.withColumnRenamed("line", "rep"), "rep").repartition("cell").sortWithinPartitions("cell")
    second = stored(cells.mapInArrow(partial(verify_cells, sets=stored_sets, percent=percent), "a long, b long").distinct())
    discard(lists, sets)

    found = components(first.unionByName(second)).withColumnRenamed("node", "line")
    seen = banded.select("doc_id", "line").join(found, "line", "left").withColumn("component", F.coalesce("component", "line"))
    owners = seen.groupBy("component").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    lines = seen.join(owners, "component").filter("doc_id > first")

    nothing = F.lit(0)
    marks = lines.select("doc_id", F.lit(LINE).alias("kind"), F.col("line").alias("hash"), nothing.cast("long").alias("around"), nothing.alias("known"))
    marks = marks.unionByName(windows.select("doc_id", F.lit(SPAN).alias("kind"), F.col("window").alias("hash"), nothing.cast("long").alias("around"), nothing.alias("known")))
    later = anchors.filter(F.col("known").bitwiseAND(LATER) > 0)
    return marks.unionByName(later.select("doc_id", F.lit(ANCHOR).alias("kind"), F.col("anchor").alias("hash"), "around", "known"))


def remove_repeats(docs: DataFrame, least: int = LEAST_WORDS, size: int = 5, percent: int = 80, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with cleaned (the text without its repeated paragraphs) and removed ([from, to) in code points).

    Repeats inside one document stay. A null text stays null, an empty one empty, and a row without doc_id or with nothing to
    remove keeps its text to the byte. Rows that repeat a doc_id are one document. Other columns may have any name.
    """
    marks = repeated_paragraphs(docs, least, size, percent)
    marked = marks.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("kind", "hash", "around", "known")).alias("_marks"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), *columns).join(marked, "_doc", "left")
    pick = lambda kind: F.filter("_marks", lambda e: e["kind"] == kind)
    hashes = lambda kind: F.transform(pick(kind), lambda e: e["hash"])
    rows = rows.select(*columns, hashes(LINE).alias("_lines"), hashes(SPAN).alias("_windows"), pick(ANCHOR).alias("_anchors"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", cleaned string, removed array<array<bigint>>"
    return rows.mapInArrow(partial(_rewrite, least=least, keep=list(keep)), schema)
