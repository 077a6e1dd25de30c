"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of lengths 0 to ``order``. In a context seen n times with d different next bytes,
a byte seen c times costs -log2(c / (n + d)) bits; an unseen byte costs -log2(d / (n + d)) for the escape plus its cost in
the next shorter context; below the empty context all 256 bytes are alike. Statistics are frozen after training, so the
code length of a text is a sum of table entries, and the shortest one names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import text_slices

UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each byte and the byte itself as one number; before a text stand zeros."""
    code, back = data.astype(np.uint32), data.astype(np.uint32)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    for i in range(1, order + 1):
        back = np.concatenate((np.zeros(1, np.uint32), back[:-1])) if len(back) else back
        back[firsts] = 0
        code |= back << np.uint32(8 * i)
    return code


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch["lang"]):
            for _, data, offsets in text_slices(batch["text"].filter(pc.equal(batch["lang"], lang))):
                codes, counts = np.unique(_codes(data, offsets, order), return_counts=True)
                names = pa.array([lang.as_py()] * len(codes), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])


@dataclass
class ContextTrees:
    """Frozen statistics: for each language and length of context, from the longest, (sequences, their bits, contexts, bits of their escapes).

    Only what a language has met is stored, so the size is that of the distinct byte sequences of the languages.
    """

    langs: list[str]
    order: int
    levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]

    def bits(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each sequence in language number ``k``."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for length, (grams, own, contexts, escape) in zip(range(self.order, -1, -1), self.levels[k], strict=True):
            code = codes[open_] & ((1 << (8 * (length + 1))) - 1)
            place = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
            met = grams[place] == code
            out[open_[met]] += own[place[met]]
            open_, code = open_[~met], code[~met] >> 8
            place = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
            known = contexts[place] == code
            out[open_[known]] += escape[place[known]]
        out[open_] += 8.0
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.diff(offsets) > 0
        firsts = offsets[:-1][full]
        if not len(firsts):
            return out
        codes, place = np.unique(_codes(data, offsets, self.order), return_inverse=True)
        codes = codes.astype(np.int64)
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(self.bits(k, codes)[place], firsts)
        return out


def grow(grams: pd.DataFrame, order: int) -> ContextTrees:
    """Trees from counts (lang, code, n) of byte sequences one longer than ``order``."""
    langs, levels = [], []
    for lang, rows in grams.groupby("lang", sort=True):
        langs.append(lang)
        codes, n = rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        own = []
        for length in range(order, -1, -1):
            met, place = np.unique(codes & ((1 << (8 * (length + 1))) - 1), return_inverse=True)
            count = np.bincount(place, n)
            contexts, place = np.unique(met >> 8, return_inverse=True)
            distinct = np.bincount(place)
            total = np.bincount(place, count) + distinct
            own.append((met, -np.log2(count / total[place]), contexts, -np.log2(distinct / total)))
        levels.append(own)
    return ContextTrees(langs, order, levels)


def train(docs: DataFrame, order: int = 2) -> ContextTrees:
    """Trees from every row of ``docs`` (text, lang); rows without text or lang teach nothing.

    Every count is kept. The model that goes to the driver and to every task has a row for each distinct (language, byte
    sequence) pair, however many rows of text there are.
    """
    usable = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = usable.mapInArrow(partial(_count, order=order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return grow(counts.toPandas(), order)


def _predict(batches: Iterator[pa.RecordBatch], trees: ContextTrees, keep: list[str]) -> Iterator[pa.RecordBatch]:
    names = np.array([*trees.langs, UNKNOWN], dtype=object)
    for batch in batches:
        for row, data, offsets in text_slices(batch["text"]):
            part = batch.slice(row, len(offsets) - 1)
            bits = trees.code_lengths(data, offsets)
            full = np.diff(offsets) > 0
            letters = np.zeros(len(full), dtype=bool)
            if full.any():
                letters[full] = np.logical_or.reduceat(_LETTER[data], offsets[:-1][full])
            for i in np.flatnonzero(full & ~letters):
                letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            best, score = np.full(len(full), len(trees.langs)), np.zeros(len(full))
            if trees.langs:
                least = bits.min(1)
                best = np.where(letters, bits.argmin(1), best)
                score = np.where(letters, 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])


def predict(docs: DataFrame, trees: ContextTrees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score, the language's share of the likelihood under equal priors.

    A null text, one without a letter, and any text when nothing was learned is ``und`` with score 0. Equal code lengths
    go to the first language in order. Only ``text`` is looked at; other columns, whatever their names, are not.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*columns).mapInArrow(partial(_predict, trees=trees, keep=list(keep)), schema)
