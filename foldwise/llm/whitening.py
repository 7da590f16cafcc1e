"""Embedding whitening: vectors as uncorrelated components of unit variance.

Vectors become whole numbers (``SCALE`` steps a unit, shifted by ``SHIFT``).  The fit
list has each distinct vector once (a Spark ``distinct``), so a vector that a third of
all rows share weighs as any other.  Sums and second moments over it are exact: they
are taken about the whole number nearest to each mean, in tasks as products of small
whole numbers, between tasks as decimals.  The eigenvectors of the covariance, a matrix
of the vectors' width, come by contour integration (``feast``); rows are projected in
one pass that needs nothing but the mean and the components.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import keep, workers_ready
from foldwise.llm.feast import greatest

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: entries beyond are taken as this much, so that they stay exact
LARGEST = 1 << 52
#: rows of a block in a task, and tasks that add up what the others found
BLOCK, MERGERS = 4_096, 16
LONGEST_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite entries."""
    def finite(c):
        c = c.cast("double")
        return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(SCALE * c) + SHIFT of each entry, as long; beyond +-``LARGEST`` that."""
    def step(c):
        x = F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE)))
        return x.cast("long") + F.lit(SHIFT).cast("long")
    return F.transform(vector, step)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


EXACT, ROUNDED = "values array<decimal(38,0)>", "values array<double>"


def _row(values: list, kind: str):
    """A task's sums, as one row."""
    import pyarrow as pa
    item = pa.decimal128(38, 0) if kind == EXACT else pa.float64()
    return pa.RecordBatch.from_arrays([pa.array([list(values)], pa.list_(item))], names=["values"])


def _totals(rows: DataFrame, run, kind: str) -> list | None:
    """``run`` over ``rows``, its tasks' sums added up by ``MERGERS`` tasks and then here; None
    if no task had a row."""
    def merge(batches):
        total = None
        for batch in batches:
            for values in batch.column(0):
                one = [int(v) if kind == EXACT else v for v in values.as_py()]
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is not None:
            yield _row(total, kind)

    merged = rows.mapInArrow(run, kind).repartition(MERGERS).mapInArrow(merge, kind).collect()
    parts = [[int(v) if kind == EXACT else v for v in r["values"]] for r in merged]
    return [sum(c) for c in zip(*parts)] if parts else None


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each entry."""
    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            for lo in range(0, len(x), 512):  # entries up to 2^53: sums of 512 fit in 63 bits
                total = [t + int(s) for t, s in zip(total, x[lo:lo + 512].sum(axis=0))]
        if n:
            yield _row([n, *total], EXACT)

    n, *sums = _totals(fit, run, EXACT) or [0] * (width + 1)
    return n, sums


def _products(fit: DataFrame, width: int, centre: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact sums of y and of y y' with y = x - centre."""
    upper = np.triu_indices(width)

    def run(batches):
        first, second = [0] * width, [0] * len(upper[0])
        seen = False
        for batch in batches:
            y = _matrix(batch.column(0), width) - centre
            seen = seen or bool(len(y))
            for lo in range(0, len(y), BLOCK):
                part = y[lo:lo + BLOCK]
                if int(np.abs(part).max()) ** 2 * len(part) < 1 << 53:  # doubles hold these sums exactly
                    f = part.astype(float)
                    found = (f.T @ f)[upper].astype(np.int64)
                else:
                    wide = part.astype(object)
                    found = wide.T.dot(wide)[upper]
                first = [a + int(b) for a, b in zip(first, part.astype(object).sum(axis=0))]
                second = [a + int(b) for a, b in zip(second, found)]
        if seen:
            yield _row([*first, *second], EXACT)

    sums = _totals(fit, run, EXACT)
    second = np.zeros((width, width), dtype=object)
    second[upper] = sums[width:]
    return sums[:width], second


class Whitening:
    """Rows, exact sums, nearest whole means, and the components of a fit list."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.centre, self.values, self.vectors, self.trace = n, sums, centre, values, vectors, trace
        #: mean - centre, at most a half
        self.rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list:
        """Exact squared distances of n x from the sums; None beyond a long."""
        y, left = x - self.centre, np.array([self.n * int(c) - s for s, c in zip(self.sums, self.centre)], dtype=object)
        far = int(np.abs(y).max()) * self.n + int(max(map(abs, left))) if len(y) else 0
        if far * far * x.shape[1] <= LONGEST_LONG:
            return ((self.n * y + left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) + left) ** 2).sum(axis=1).tolist()
        return [v if v <= LONGEST_LONG else None for v in exact]


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Of a frame of distinct whole vectors (one column, ``width`` long entries); None without rows."""
    workers_ready(fit.sparkSession)
    n, sums = _sums(fit, width)
    if not n:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    first, second = _products(fit, width, centre)
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            v[i, j] = v[j, i] = (n * second[i, j] - first[i] * first[j]) / n ** 2  # whole numbers, divided once
    values, vectors = greatest(v, components)
    return Whitening(n, sums, centre, values, vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    width, k = len(model.centre), len(model.values)
    upper = np.triu_indices(k)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whiten(_matrix(batch.column(0), width))
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield _row(np.r_[first, second[upper]].tolist(), ROUNDED)

    sums = np.array(_totals(fit, run, ROUNDED))
    mean = sums[:k] / model.n
    error = sums[k:] / model.n - np.outer(mean, mean)[upper] - (upper[0] == upper[1])
    return float(np.abs(error).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable row of ``vectors`` and component (1 has the greatest eigenvalue): vec_id,
    component, n (distinct vectors), deviation (exact sum over dimensions of (n x - S)^2; null
    beyond a long), whitened, explained (the component's share of the variance), identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries, drop, and so do
    vectors of another length than most distinct ones have (ties: the longer).  Repeated rows
    and null ids have rows.  There are fewer components where the distinct vectors span fewer
    dimensions, none where all are equal, and no rows then; other columns are not read; an
    empty table has no rows.
    """
    spark = vectors.sparkSession
    workers_ready(spark)
    vector = F.col(vector_col)
    rows = vectors.where(usable(vector)).select(F.col(id_col).alias("vec_id"), whole(vector).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = keep(rows.select("x").distinct())
    widths = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head(1)
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    fit = distinct.where(F.size("x") == width)
    model = fit_whitening(fit, width, components)
    if not len(model.values):
        return spark.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.values)
    explained = model.values / model.trace

    def run(batches):
        import pyarrow as pa
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                x = _matrix(batch.column(1), width)
                m = len(x)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                     pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(run, schema)
