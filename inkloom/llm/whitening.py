"""Whitening of embeddings by a randomised range finder.

The covariance V of all rows is never needed as a whole unless the spectrum asks
for it. A random start of ``components + oversample`` directions passes through V
a few times; each pass reads every row once, centres it, and adds up
(x - mean)(x - mean)' Q for the directions Q (d numbers a direction come back,
whatever the number of rows). Directions are made orthonormal between passes.
Rayleigh-Ritz on the range found gives eigenvalues and eigenvectors, and the
residuals |Vu - eu| against the gaps between eigenvalues bound their errors. If
these bounds miss ``tolerance`` after ``passes``, the range becomes the full
dimension: one more pass gives V itself, whose eigenvectors Rayleigh-Ritz finds
to double precision.

Sums are exact integers. Partial products are added by task in a fixed order, so
reruns over the same files agree; the sign of a component makes its largest entry
positive. The driver holds d by (components + oversample) numbers, d by d at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import settle
from inkloom.llm.vectors import matrix

ENTRY = 1 << 50  # entries of an integer vector stay below, so that doubles hold them and sums of a batch fit a long


def integers(vectors: DataFrame, *, scale: float, shift: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and ``x``: floor(scale * c) + shift of every component, for the rows to fit on, written.

    Vectors that are null or empty or hold null or non-finite components, or
    one whose integer isn't below 2^50, and vectors of another length than most
    rows (of equally frequent lengths, the greatest counts) are left out; zero
    vectors and repeated rows stay.
    """
    c = F.col(vec_col).cast("array<double>")
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < float(ENTRY))
    x = vectors.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, fits))
    x = settle(x.select(F.col(id_col), F.transform(c, lambda v: F.floor(v * F.lit(float(scale))) + F.lit(shift)).alias("x")), "integers")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (length["d"] if length else 0))


@dataclass
class Whitening:
    """n rows, exact sums by dimension, eigenvalues and unit eigenvectors (d by components), trace of V, and the greatest error of the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int = 0
    full: bool = False

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                some = [sum(int(s) for s in column) for column in zip(*(flat[i : i + 4096].sum(0) for i in range(0, len(flat), 4096)))]
                n, sums = n + batch.num_rows, some if sums is None else [a + b for a, b in zip(sums, some)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": range(-1, len(sums)), "s": [str(s) for s in [n, *sums]]}, pa.schema([("i", pa.int32()), ("s", pa.string())]))

    added = vectors.select("x").mapInArrow(part, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = [int(r.s) for r in added.orderBy("i").collect()]  # one row a dimension
    return (got[0], got[1:]) if got else (0, [])


def product(vectors: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over all rows of (x - mean)(x - mean)' q, and of |x - mean|^2."""
    sent = vectors.sparkSession.sparkContext.broadcast((mean, q))
    columns = q.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, directions = sent.value
        total, square, seen = np.zeros(directions.shape), 0.0, False
        for batch in batches:
            if batch.num_rows:
                seen = True
                y = matrix(batch.column(0)) - m
                total += y.T @ (y @ directions)
                square += float((y * y).sum())
        if seen:
            rows = [*total.tolist(), [square] + [0.0] * (columns - 1)]
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": range(len(rows)), "part": [at] * len(rows), "y": rows}, pa.schema([("i", pa.int32()), ("part", pa.int32()), ("y", pa.list_(pa.float64()))]))

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": p["i"].iloc[:1], "y": [np.vstack(p.sort_values("part")["y"].to_numpy()).sum(0)]})  # one row a task

    parts = vectors.select("x").mapInArrow(part, "i int, part int, y array<double>")
    got = parts.groupBy("i").applyInPandas(add, "i int, y array<double>").orderBy("i").collect()  # one row a dimension
    got = np.array([r.y for r in got])
    return got[:-1], float(got[-1, 0])


def ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the range of ``q`` with y = Vq: values falling, vectors, residual lengths."""
    t = q.T @ y
    values, turn = np.linalg.eigh((t + t.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.sqrt(((y @ turn - vectors * values) ** 2).sum(0))


def exact(values: np.ndarray, residuals: np.ndarray, k: int, tolerance: float) -> bool:
    """Whether the first k Ritz vectors are within ``tolerance``, by residuals over gaps to the other Ritz values.

    Values beyond the range found are unseen, so the last value found stands for
    them: the range must hold more directions than k.
    """
    if len(values) <= k:
        return False
    for i in range(k):
        gap = np.abs(np.delete(values, i) - values[i]).min()
        if not residuals[i] <= tolerance * gap or not residuals[i] <= tolerance * values[i]:
            return False
    return True


def fit(vectors: DataFrame, *, components: int = 8, oversample: int = 8, passes: int = 3, tolerance: float = 1e-12, seed: int = 13) -> Whitening:
    """Components of ``vectors`` (x: arrays of long of one length; a written table, as every pass reads it).

    Components without variance (eigenvalue below the rounding error of the
    largest) can't be whitened and are left out, so constant rows, or a single
    one, have none.
    """
    n, sums = totals(vectors)
    out = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0)
    if not n:
        return out
    d, mean = len(sums), out.mean
    k = min(components, d)
    width = min(d, components + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    found = None
    for step in range(passes if width < d else 0):
        y, square = product(vectors, mean, q)
        out.passes, y = step + 1, y / n
        found = ritz(q, y)
        if exact(found[0], found[2], k, tolerance):
            break
        found, q = None, np.linalg.qr(y)[0]
    if found is None:
        y, square = product(vectors, mean, np.eye(d))
        out.passes, out.full = out.passes + 1, True
        found = ritz(np.eye(d), y / n)
    values, directions, _ = found
    out.trace = square / n
    k = int((values[:k] > d * np.finfo(float).eps * max(values[0], 0.0)).sum())
    values, directions = values[:k], directions[:, :k]
    out.values = values
    out.vectors = directions * np.where(directions[np.abs(directions).argmax(0), range(k)] < 0, -1.0, 1.0)
    if k:  # the covariance of the whitened rows, in a pass of its own
        y, _ = product(vectors, mean, out.vectors)
        white = out.vectors.T @ y / n / np.sqrt(np.outer(values, values))
        out.identity_error = float(np.abs(white - np.eye(k)).max())
    return out


def deviations(flat: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the exact sum over dimensions of (n x - S)^2."""
    most = max((n * int(m) - s for m, s in zip(flat.max(0), sums)), default=0), max((s - n * int(m) for m, s in zip(flat.min(0), sums)), default=0)
    if max(most) ** 2 * len(sums) < 1 << 63 and n * int(np.abs(flat).max()) < 1 << 63:
        y = flat * n - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in flat.tolist()]


def transform(vectors: DataFrame, model: Whitening, *, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation decimal(38,0), whitened, explained, identity_error."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    x = vectors.select(id_col, "x")
    k = len(model.values)
    schema = f"`{id_col}` {x.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        w = sent.value
        project, share = w.vectors / np.sqrt(w.values), w.values / w.trace
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                flat = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1)
                rows = some.num_rows
                away = pa.array([Decimal(v) for v in deviations(flat, w.n, w.sums)], pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    some.column(0).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n, np.int64)),
                    away.take(again),
                    pa.array(((flat - w.mean) @ project).ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * k, w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    return x.mapInArrow(run, schema)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", components: int = 8, **how) -> DataFrame:
    """``transform`` of ``fit``: every row of ``vectors`` (id, x) on its first ``components`` components.

    Null ids and repeated rows stay; an empty table, or one whose rows are all
    equal, gives an empty result (there is no variance to scale by).
    """
    return transform(vectors, fit(vectors, components=components, **how), id_col=id_col)
