"""Quality classifier by importance resampling.

Two generative models, bags of hashed words and word pairs, are fitted: one on target text, one on the raw corpus. The log
of a document's likelihood ratio is its importance weight; adding Gumbel noise and taking the k largest keys samples k
documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import BYTE_AS_IS, cut, shingle_hashes, span_hashes, text_slices, token_bounds

#: Hash buckets of the models: the lower half for words, the upper half for pairs.
BUCKETS = 1 << 15
#: A document's weight is that of a passage of so many features at most, else length alone would decide.
PASSAGE = 200
#: Log weight from which a document counts as target text when k is not given. Ordinary text lies around 0 whatever its
#: length; text of another kind loses this much within a few words.
LEAST_WEIGHT = -8.0


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    """Bucket numbers of each row's words and pairs; runs of letters or digits and runs of signs are words."""
    half = np.uint64(BUCKETS // 2)
    for _, data, offsets in text_slices(column):
        starts, ends, first = token_bounds(data, offsets)
        words = span_hashes(data, starts, ends, BYTE_AS_IS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            pairs = shingle_hashes(words[a:b], 2) if b - a > 1 else words[:0]
            yield np.concatenate((words[a:b] % half, pairs % half + half)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        ids = batch["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        for good, found in zip(np.isin(ids, targets), _features(batch["text"]), strict=True):
            np.add.at(raw, found, 1)
            if good:
                np.add.at(target, found, 1)
    met = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, most_targets: int = 50_000) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket, with add-one counts.

    The raw model covers every document. The target model covers documents labelled with quality 1; of these ids the
    ``most_targets`` with the smallest hashes are used, a bounded sample of labelled rows. A document with contradicting
    labels, null labels and labels without a document teach nothing. Without labels every ratio is 0.
    """
    sure = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    sure = sure.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    targets = sure.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_targets).toPandas()["doc_id"].to_numpy(np.int64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(partial(_count, targets=np.sort(targets)), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counts.toPandas()  # a row for each bucket
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    if not found["target"].sum():
        return np.zeros(BUCKETS)
    ratio = np.empty(BUCKETS)
    for half in (slice(None, BUCKETS // 2), slice(BUCKETS // 2, None)):
        ratio[half] = np.log(target[half] / target[half].sum()) - np.log(raw[half] / raw[half].sum())
    return ratio


def _weigh(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = np.array([ratio[found].sum() * min(1, PASSAGE / max(len(found), 1)) for found in _features(batch["text"])], dtype=float)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(weights)], names=[*keep, "log_weight"])


def gumbel(seed: int, *columns: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the columns alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1000, few: int = 10_000) -> float:
    """The k-th largest value, found by counting in ever finer bins; at most ``few`` values or ``bins`` counts are collected."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        inside = df.filter(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in rows:
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= few:
            values = df.filter(F.col(column).between(low, high)).select(column).toPandas()[column]
            return float(values.nlargest(k).iloc[-1])
    return low


def resample(docs: DataFrame, ratio: np.ndarray, k: int | None = None, seed: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with log_weight, key (log weight plus Gumbel noise) and kept: key is among the k largest.

    Without k, as many are kept as have a log weight of LEAST_WEIGHT or more. Rows with equal doc_id and text get equal
    keys; ties at the k-th key are all kept. An empty or null text has weight 0 and is kept like any weight above the bound.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select(F.xxhash64(F.col("text")).alias("_text_hash"), F.col("doc_id").cast("long").alias("_doc"), *columns)
    carried = ["_text_hash", "_doc", *keep]
    schema = "_text_hash long, _doc long, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "log_weight double"
    key = F.col("log_weight") + gumbel(seed, F.col("_doc"), F.col("_text_hash"))
    weigh = lambda rows, carried, schema: rows.mapInArrow(partial(_weigh, ratio=ratio, keep=carried), schema).withColumn("key", key)
    keys = cut(weigh(rows.select("_text_hash", "_doc", "text"), ["_text_hash", "_doc"], "_text_hash long, _doc long, log_weight double").select("log_weight", "key"))
    n, fitting = keys.agg(F.count("*"), F.count_if(F.col("log_weight") >= LEAST_WEIGHT)).first()
    k = fitting if k is None else min(k, n)
    bound = kth_largest(keys, "key", k) if k else float("inf")
    return weigh(rows, carried, schema).select(*keep, "log_weight", "key", (F.col("key") >= bound).alias("kept"))
