"""Helpers shared by the operators: lineage cuts, connected components, word hashing over Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bourselake.session import freed_shuffles

#: White space between words; every other byte belongs to a word.
SPACES = (0x20, *range(0x09, 0x0E))

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False

_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
BYTE_AS_IS = _BYTE
BYTE_LOWERED = _BYTE[_LOWER]
_STEP = 0x9E3779B97F4A7C13 | 1
_BACK = pow(_STEP, -1, 2**64)


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands texts to Python some 8 MB at a time.

    Ten thousand rows, the usual batch, may be any size, and an executor holds several batches in its JVM and its workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the rows lie in the shared checkpoint folder, so a lost executor costs nothing."""
    shared_checkpoints(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a query takes the setting when it is made, not when it runs


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the shared folder, which ``discard`` removes when it is no longer read."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``stored``; nothing that reads them may be computed after this."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links; the component is the smallest node it can reach.

    Alternates large-star and small-star contractions until nothing changes. Minima are pre-aggregated per task, and the
    join back to a hub with many neighbours is an equi-join that adaptive execution can split. Null ends are ignored.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    stars = stored(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        # rows are distinct, so equal counts and 128 bits of hashes mean equal stars; they are counted while they are written
        watched = Observation()
        small = small.observe(watched, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "v", "u")).alias("y"))
        older, stars = stars, stored(small)
        discard(older)
        now = watched.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def text_slices(column: pa.Array, most_bytes: int = 250_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; a null row has no bytes. No row is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(len(column), max(row + 1, end))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and the index of each row's first word, one more for the end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[list(SPACES)] = 0
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1


def token_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_bounds, for runs of letters and digits (with all bytes beyond ASCII) and runs of other signs."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    bounds = np.flatnonzero(change)
    starts, ends = bounds[:-1], bounds[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, _STEP, dtype=np.uint64), np.full(size, _BACK, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWERED) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes at any place."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers_to(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; with fewer words, of the whole sequence; none without words."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = (total + words[i : len(words) - size + 1 + i]) * np.uint64(_STEP)
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a string column."""
    for _, data, offsets in text_slices(column):
        starts, ends, first = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            found = shingle_hashes(words[a:b], size)
            found.sort()
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found
