"""Near-duplicate embeddings by the epsilon grid order join.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart. They are rotated to their principal dimensions, laid on a grid of
that width, and sorted by the grid cells of the leading dimensions. The sorted sequence is cut into intervals; two intervals
are joined by halving them again and again, and halves whose bounding boxes are further apart than the width are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import components, cut

#: Leading dimensions whose grid cells order the vectors and bound the intervals.
LEADING = 8
#: Vectors of an interval, and of a half that is compared without another cut.
INTERVAL, LEAF = 1024, 64

_FLOATS = "array<double>"


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length 1 in double precision, None for one that links with nothing."""
    out = []
    for x in column:
        v = None if not x.is_valid else np.array(x.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        if v is None or not len(v) or not np.isfinite(v).all() or not (top := np.abs(v).max()) > 0:
            out.append(None)
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and outer products of the unit vectors, for each length of vectors."""
    totals: dict[int, list] = {}
    for batch in batches:
        units = [v for v in _units(batch["embedding"]) if v is not None]
        for dim in {len(v) for v in units}:
            x = np.stack([v for v in units if len(v) == dim])
            total = totals.setdefault(dim, [0, np.zeros(dim), np.zeros((dim, dim))])
            for i, y in enumerate((len(x), x.sum(0), x.T @ x)):
                total[i] = total[i] + y
    for dim, (n, s, outer) in totals.items():
        rows = np.concatenate(([n], s, outer.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(rows)], names=["dim", "i", "x"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal axes (columns) by falling variance, for each vector length; sums over all vectors, dim * dim numbers collected."""
    sums = vectors.select("embedding").mapInArrow(_sums, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for dim, own in sums.sort_values("i").groupby("dim"):
        x = own["x"].to_numpy()
        mean = x[1 : dim + 1] / x[0]
        axes[int(dim)] = np.linalg.eigh(x[dim + 1 :].reshape(dim, dim) / x[0] - np.outer(mean, mean))[1][:, ::-1]
    return axes


def _rotate(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], width: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _units(batch["embedding"])
        kept = [i for i, v in enumerate(units) if v is not None]
        turned = [units[i] @ axes[len(units[i])] for i in kept]
        cells = [np.floor(v[:LEADING] / width).astype(np.int64).tolist() for v in turned]
        part = batch.take(pa.array(kept, pa.int64()))
        columns = [part["vec_id"], part["label"], pa.array([len(v) for v in turned], pa.int32()), pa.array(cells, pa.list_(pa.int64())), pa.array([units[i].tobytes() for i in kept], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v[:LEADING].tobytes() for v in turned], pa.binary())], names=["vec_id", "label", "dim", "cells", "unit", "lead"])


def _distance(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Least distance of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt(gap @ gap))


def _join(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, least: float, width: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first row, links) of the leaves of two sequence intervals that may hold links."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        x, y, u, v = stack.pop()
        if same and v <= x:
            continue
        if _distance(lead_a[x:y].min(0), lead_a[x:y].max(0), lead_b[u:v].min(0), lead_b[u:v].max(0)) > width:
            continue
        if y - x <= LEAF and v - u <= LEAF:
            yield x, u, a[x:y] @ b[u:v].T >= least
        elif y - x >= v - u:
            m = (x + y) // 2
            stack += [(x, m, u, v), (m, y, u, v)]
        else:
            m = (u + v) // 2
            stack += [(x, y, u, m), (x, y, m, v)]


def _forest(ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links (i, j) connect, at most one for each vector."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((x, y))
    return out


def _meet(table: pa.Table, least: float, width: float) -> pa.Table:
    """Links of two intervals (or of one with itself): (a, b, null) for a link that connects, (a, null, n) for n direct links of a."""
    sides = []
    for row in table.sort_by("mine").to_pylist():
        unit, lead = (np.frombuffer(row[c], np.float64).reshape(len(row["ids"]), -1) for c in ("units", "leads"))
        sides.append((np.array(row["ids"]), np.array(row["times"]), unit, lead))
    (ids_a, times_a, a, lead_a), (ids_b, times_b, b, lead_b) = sides[0], sides[-1]
    same = len(sides) == 1
    count_a, count_b, rows = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
    for x, u, links in _join(a, b, lead_a, lead_b, least, width, same):
        if same:
            links &= np.arange(x, x + links.shape[0])[:, None] < np.arange(u, u + links.shape[1])
        if links.any():
            count_a[x : x + links.shape[0]] += links @ times_b[u : u + links.shape[1]]
            count_b[u : u + links.shape[1]] += times_a[x : x + links.shape[0]] @ links
            i, j = np.nonzero(links)
            rows += [(p, q, None) for p, q in _forest(ids_a, ids_b, i + x, j + u)]
    rows += [(int(p), None, int(n)) for ids, count in ((ids_a, count_a), (ids_b, count_b)) for p, n in zip(ids, count, strict=True) if n]
    return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate("abn")})


def near_embeddings(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null, their lengths are equal and their cosine in double precision
    is ``least`` or more. Vectors that are null, empty or zero or hold null or non-finite components link with nothing; so do
    those without vec_id. Copies fold first: equal vectors of a label are one, with its number. Each pair of intervals gives
    back counts and at most one connecting link for each vector of a leaf, never its pairs. Rows that repeat a vec_id are
    one node; if their vectors differ, n_links are those of the vector whose copies hold the smallest vec_id.
    """
    width = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(_FLOATS).alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = rows.filter("vec_id is not null and embedding is not null and label is not null")
    axes = principal_axes(usable)
    turned = usable.mapInArrow(partial(_rotate, axes=axes, width=width), "vec_id long, label string, dim int, cells array<long>, unit binary, lead binary")
    turned = cut(turned)
    key = ["label", "dim", "cells", "unit", "lead"]
    classes = cut(turned.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")))

    ranged = classes.repartitionByRange("label", "dim", "cells", "rep").sortWithinPartitions("label", "dim", "cells", "rep")
    cells = ranged.mapInArrow(_intervals, "label string, dim int, piece long, ids array<long>, times array<long>, units binary, leads binary, low array<long>, high array<long>")
    pieces = cut(cells)
    boxes = pieces.select("label", "dim", "piece", "low", "high")
    reach = boxes.select("*", F.explode(F.expr("sequence(low[0] - 1, high[0] + 1)")).alias("cell"))
    home = boxes.select(F.col("label"), F.col("dim"), F.col("piece").alias("other"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.expr("sequence(low[0], high[0])")).alias("cell"))
    near = F.forall(F.arrays_zip("low", "high", "low_b", "high_b"), lambda z: (z["low"] <= z["high_b"] + 1) & (z["low_b"] <= z["high"] + 1))
    pairs = reach.join(home, ["label", "dim", "cell"]).filter((F.col("piece") <= F.col("other")) & near).select(F.col("piece").alias("one"), "other").distinct()
    sides = pairs.select("one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("mine"))
    met = sides.join(pieces.select(F.col("piece").alias("mine"), "ids", "times", "units", "leads"), "mine").groupBy("one", "other")
    found = cut(met.applyInArrow(lambda table: _meet(table, least, width), "a long, b long, n long"))

    several = turned.join(classes, key).select("vec_id", "rep")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    own = classes.groupBy("rep").agg(F.sum("times").alias("times"))
    linked = own.join(counts, "rep", "left").select("rep", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    ids = several.groupBy("vec_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    joined = found.filter("b is not null").select("a", "b").unionByName(ids.filter("rep < last").select(F.col("rep").alias("a"), F.col("last").alias("b")))
    groups = components(joined).withColumnRenamed("node", "rep")
    per_id = ids.join(linked, "rep", "left").join(groups, "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id").join(per_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one label and length, up to INTERVAL at a time, as one row with their box on the grid."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        frame = batch.to_pandas()
        out = []
        for (label, dim), own in frame.groupby(["label", "dim"], sort=False):
            for i in range(0, len(own), INTERVAL):
                part = own.iloc[i : i + INTERVAL]
                cells = np.stack(part["cells"].to_numpy())
                out.append((label, dim, number, part["rep"].tolist(), part["times"].tolist(), b"".join(part["unit"]), b"".join(part["lead"]), cells.min(0).tolist(), cells.max(0).tolist()))
                number += 1
        names = ["label", "dim", "piece", "ids", "times", "units", "leads", "low", "high"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
