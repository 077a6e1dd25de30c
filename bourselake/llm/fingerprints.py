"""One-permutation MinHash fingerprints, in DataFrame functions alone.

Every shingle of a text is hashed once. The upper bits of the hash choose one of BINS bins, each bin keeps its least hash,
an empty bin borrows from a bin chosen by hashing its number and the attempt until a full one is found (optimal
densification), and the low BITS bits of each bin are packed into a string. Two unlike bins agree in their low bits with
probability 2^-BITS, which the likeness corrects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins, a power of two; low bits kept of each, at most 8.
BINS, BITS = 128, 8
#: Attempts by hash before an empty bin looks at all bins in turn.
ATTEMPTS = 16
#: Rows of one window partition when neighbours by doc_id are sought, up to MOST_RANGES ranges.
RANGE_ROWS, MOST_RANGES = 1000, 10_000

_SHIFT = 63 - (BINS.bit_length() - 1)


def with_fingerprint(df: DataFrame, text: str, name: str, size: int = 5) -> DataFrame:
    """Adds ``name``: array<tinyint> of BINS low parts, empty when the text has no word; a null text counts as empty.

    Shingles are ``size`` consecutive words, lower-cased, between ASCII white space; fewer words make one shingle. Each step
    is a column of its own, so that no array is computed again for each of its elements.
    """
    step = f"_{name}"
    df = df.withColumn(step, F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), ""))
    df = df.withColumn(step, F.transform(step, lambda w: F.xxhash64(w)))
    words = F.col(step)
    shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + F.lit(j)) for j in range(size))), 1)
    found = F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), shingle)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(step, F.array_sort(found))
    ordered = F.col(step)
    bin_of = lambda x: F.shiftright(x, _SHIFT).cast("int")
    df = df.withColumn(step, F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1)))))
    least = F.col(step)
    none = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    placed = F.flatten(F.transform(least, lambda x, i: F.concat(none(bin_of(x) - F.coalesce(bin_of(F.get(least, i - 1)), F.lit(-1)) - 1), F.array(x))))
    df = df.withColumn(step, F.when(F.size(least) > 0, F.concat(placed, none(BINS - 1 - bin_of(F.element_at(least, -1))))).otherwise(F.array().cast("array<bigint>")))
    bins = F.col(step)
    hashed = lambda b, t: F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int")
    by_hash = lambda b: F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS)), lambda t: F.get(bins, hashed(b, t))), lambda y: y.isNotNull()), F.lit(0))
    in_turn = lambda b: F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda t: F.get(bins, (b + t) % BINS)), lambda y: y.isNotNull()), F.lit(0))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)) - F.lit(1 << (BITS - 1))
    df = df.withColumn(name, F.transform(bins, lambda x, b: low(F.coalesce(x, by_hash(b), in_turn(b))).cast("tinyint")))
    return df.drop(step)


def packed(fingerprint: str) -> Column:
    """Two hex digits for each bin; the empty string without words."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + (1 << (BITS - 1)))), 2, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard of the shingle sets, 0 to 1: the share of equal bins, corrected for agreement by chance.

    Two texts without words are alike (1.0), one such text and another are not (0.0).
    """
    by_chance = 1 / (1 << BITS)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / BINS
    corrected = F.greatest((same - by_chance) / (1 - by_chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(corrected)


def with_next(df: DataFrame, key: str, tie: Column, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds next_<column> of the following row in ascending order of ``key`` (nulls first), then ``tie``; the last row's next is the first.

    Rows are dealt into ranges of the key at approximate quantiles; inside a range a window looks ahead, and the last row of
    a range gets the first row of the next range that has rows. Ranges hold about RANGE_ROWS rows, so no task orders the table.
    ``derive`` adds columns to the rows before they move; they move once.
    """
    n = df.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    bounds = F.array(*(F.lit(int(c)) for c in cuts)) if cuts else None
    search = lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col(key), at + s).otherwise(at)
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search) if cuts else F.lit(0)
    df = df.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(place)).withColumn("_tie", tie)
    order = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(), "_tie")
    ahead = {"_more": F.lead(F.lit(True)).over(order)} | {f"next_{c}": F.lead(c).over(order) for c in columns}
    looked = derive(df).select("*", *(x.alias(c) for c, x in ahead.items()))

    # the first row of each range: at most MOST_RANGES + 1 rows of three numbers are broadcast to find them
    firsts = df.groupBy("_range").agg(F.min(F.struct(F.coalesce(key, F.lit(0)).alias("k"), F.col("_tie").alias("t"))).alias("at")).select(F.col("_range").alias("_first"), "at")
    same = (F.col("_range") == F.col("_first")) & F.col(key).eqNullSafe(F.when(F.col("_first") >= 0, F.col("at.k"))) & (F.col("_tie") == F.col("at.t"))
    heads = df.join(F.broadcast(firsts), same).dropDuplicates(["_range"]).select(*df.columns)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(F.col("_first").alias("_range"))  # one row for each range
    after = after.select(F.col("_range").alias("_of"), F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.first("_range").over(whole)).alias("_range"))
    heads = derive(heads).select("_range", F.struct(*columns).alias("_head")).join(F.broadcast(after), "_range").drop("_range")
    out = looked.join(heads, looked["_range"] == heads["_of"], "left")
    out = out.withColumns({f"next_{c}": F.when(F.col("_more"), F.col(f"next_{c}")).otherwise(F.col(f"_head.{c}")) for c in columns})
    return out.drop("_range", "_tie", "_more", "_of", "_head")


def document_fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first, or all it
    has. A null text is empty. Rows without doc_id come first; rows that repeat a doc_id follow each other in the order of
    their texts' hashes. Only doc_id and text are looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", F.xxhash64("text"), ["text", "own"], lambda df: with_fingerprint(df, "text", "own", size))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "changed", size)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed("own").alias("fingerprint"),
        packed("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
