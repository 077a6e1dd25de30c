"""MinHash near-duplicates by bottom-k sketches from one hash function.

Every document keeps the k smallest hashes of its word shingles. Inverted lists of the retained values give candidate
pairs, the sketch of the union estimates their similarity, and the exact Jaccard of the full sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.cells import marks_of, may_link, meeting_again, mixed, text_sets, verify_cells, with_partners
from bourselake.llm.common import components, cut, discard, mix, shingle_sets, stored

#: Retained values per document.
SKETCH = 48
#: Pairs whose union sketch estimates less are not verified. At a true 0.8 an estimate from 48 values has a deviation of
#: 0.058, so a link is lost here once in some hundred thousand; sets of up to 48 shingles are compared exactly.
LEAST_ESTIMATE = 0.54

_SKETCHED = pa.schema([("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sums, others, kept = [], [], [], []
        for found in shingle_sets(batch["text"], size):
            counts.append(len(found))
            sums.append(int(found.sum(dtype=np.uint64)))
            others.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            kept.append(found[:k].view(np.int64))
        sketches = pa.ListArray.from_arrays(
            np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))
        )
        signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sums, others)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), *signed, sketches], names=["doc_id", *_SKETCHED.names])


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}

    def sets(column: pa.Array) -> list[np.ndarray]:
        """Of each row; a text met again shortly after is not read twice."""
        texts = column.to_pylist()
        new = list({t for t in texts if t not in known})
        if sum(map(len, known)) > 20_000_000:
            known.clear()
            new = list(set(texts))
        known.update(zip(new, shingle_sets(pa.array(new, pa.string()), size), strict=True))
        return [known[t] for t in texts]

    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            same = []
            for x, y in zip(a := sets(part["text_a"]), b := sets(part["text_b"]), strict=True):
                both = np.concatenate((x, y))
                both.sort()
                same.append(int((both[1:] == both[:-1]).sum()))
            same, union = np.array(same), np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
            yield part.select(["a", "b"]).filter(pa.array(100 * same >= percent * (union - same)))


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have the Jaccard asked for."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.filter("text is not null").join(ends, "doc_id", "left_semi")
    sided = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return sided.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, size=size, percent=percent), "a long, b long")


def _estimated(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose union sketch estimates enough of it."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    likeness = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b"))) / F.size(union)
    return pairs.filter(likeness >= LEAST_ESTIMATE)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text string; other columns are ignored).

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``size``-word shingles
    (A-Z lowered; words end at ASCII white space; fewer words make one shingle). The component is the smallest doc_id reachable.
    Null, empty or blank texts have an empty set and link with nothing. Rows that repeat a doc_id are one node with all its
    texts. A null doc_id is no node: it takes the component of an equal text, else null, and kept is then null.

    Equal sets fold first, so copies never meet as pairs. In each inverted list every member meets the list's smallest
    document. Only where members then lie in different components are they compared further, in blocks of bounded size: on
    their sketches, and those that have a likely partner on their full sets, which gives back no more than a link for each two components.
    Only the rarest values of a sketch are listed: two sketches that share enough values share one of those.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = cut(docs.mapInArrow(partial(_sketch, size=size, k=k), "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>"))
    key = ["s1", "s2", "n_shingles"]
    classes = sketched.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = sketched.select("doc_id", *key).join(classes, key, "left")
    reps = sketched.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *key]).dropDuplicates(["doc_id", *key])
    reps = cut(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch"))

    posted = reps.select("rep", "n", F.explode("sketch").alias("value"))
    common = posted.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(common, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("listed"))
    held = F.least(F.col("n"), F.lit(k))
    complete = F.col("n") * 100 <= k * percent  # its sketch and those of all it can be linked with are whole sets
    needed = F.when(complete, F.ceil(F.col("n") * percent / 100)).otherwise(F.ceil(held * LEAST_ESTIMATE))
    shared = shared.withColumn("most", (held - needed + 1 - (held - F.size("listed"))).cast("int")).filter("most > 0")
    lists = cut(shared.select("rep", "n", F.explode(F.slice("listed", F.lit(1), F.least(F.col("most"), F.size("listed")))).alias("x")).select("rep", "n", F.col("x.value").alias("value")))

    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    marks = reps.select("rep", marks_of("sketch").alias("marks"))
    sided = lambda pairs, values, c: pairs.join(values.toDF("a", f"{c}_a"), "a").join(values.toDF("b", f"{c}_b"), "b")
    # most pairs share one value and little else, so whole sketches move only for those whose marks are alike
    likely = lambda pairs: sided(pairs, marks, "marks").filter(may_link("marks_a", "marks_b", k)).select("a", "b")
    links_of = lambda pairs: _links(cut(_estimated(sided(likely(pairs), reps.select("rep", "sketch"), "sketch"), k).select("a", "b")), docs, size, percent)
    hubs = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    spokes = lists.join(hubs, "value").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("hub.n").alias("n"), F.col("n").alias("m"))
    several = members.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    several = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    links = cut(several.unionByName(links_of(spokes.filter(fits & (F.col("a") < F.col("b"))).select("a", "b").distinct())))

    again = stored(with_partners(meeting_again(mixed(lists, links), percent), marks, k))
    texts = docs.filter("text is not null").join(again.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    cells = again.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    rest = cells.mapInArrow(partial(verify_cells, sets=partial(text_sets, size=size), percent=percent), "a long, b long")
    links = links.unionByName(cut(rest.distinct()))
    discard(again)

    found = components(links).withColumnRenamed("node", "rep")
    out = members.join(found, "rep", "left").withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
