"""Embedding whitening by a one-sided Jacobi SVD of a tall-skinny QR.

Entries become whole numbers, whose sums are exact.  The centred rows are never held
together nor multiplied with each other: every task folds its rows, block by block, into
the triangle R of their QR factorisation, and triangles are folded in rounds of FAN until
one is left, which has the same singular values and right singular vectors as all rows.
Plane rotations then make R's columns orthogonal; the rotations multiplied together are
the components, and the columns' lengths are the standard deviations times the square
root of the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Whole numbers are floor(STEP * c) + SHIFT.
STEP, SHIFT = 64, 1_000_000
#: The whole numbers of larger entries do not fit 64 bits: such vectors are left out.
LARGEST = float(1 << 56)
#: Rows of a block that is folded into the triangle, and triangles folded by one task.
BLOCK, FAN = 2048, 32
#: Sweeps of rotations; they end when no pair of columns is further from orthogonal than this.
SWEEPS, ORTHOGONAL = 60, 1e-15


def vectors(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and whole numbers of the usable vectors of a batch in which all have one length."""
    lists = batch.column(at)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.arange(len(lists))
    return rows, np.floor(STEP * flat.reshape(len(lists), -1)).astype(np.int64) + SHIFT


def gaps(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: in 64 bits where they suffice, else in whole numbers of any size."""
    most = max(int(np.abs(x).max(initial=0)), -(-max(map(abs, sums), default=0) // n))
    return n * x - np.array(sums, np.int64) if n * most < 1 << 62 else n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (gaps(x, n, sums) / n).astype(float)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows of key and vector whose vectors are not null or empty and hold finite entries only."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST), F.lit(False)))
    return df.select(F.col(key).alias("_key"), v.cast("array<double>").alias("_vector")).filter(v.isNotNull() & (F.size(v) > 0) & fine)


def folded(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows above and below each other: d rows at most."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def triangle(spark: SparkSession, rows: DataFrame, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """R of the centred rows x - S / n, folded by tasks, then by rounds of FAN triangles."""
    d = len(sums)

    def fold(batches):
        r = None
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                _, x = vectors(batch.slice(k, BLOCK), 0)
                r = folded(r, centred(x, n, sums))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def again(some: pd.DataFrame) -> pd.DataFrame:
        r = None
        for raw in some["r"]:
            r = folded(r, np.frombuffer(raw).reshape(-1, d))
        return pd.DataFrame({"r": [r.tobytes()]})

    found = scratch.save(rows.select("_vector").mapInArrow(fold, "r binary"), "triangles-0")
    left, k = found.count(), 0
    while left > 1:
        k, left = k + 1, -(-left // FAN)
        dealt = found.select(F.pmod(F.xxhash64("r"), F.lit(left)).alias("at"), "r")
        found = scratch.save(dealt.groupBy("at").applyInPandas(again, "r binary"), f"triangles-{k}")
        left = found.count() if left > 1 else 1
    return np.frombuffer(found.head().r).reshape(-1, d)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by plane rotations of columns.

    A round rotates pairs of columns that have no column in common, so all at once; a
    sweep's rounds meet every pair once (the circle method of tournaments).
    """
    d = r.shape[1]
    m = d + d % 2
    a, v = np.zeros((r.shape[0], m)), np.eye(m)
    a[:, :d] = r
    order = np.arange(m)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(m - 1):
            i, j = order[: m // 2], order[m // 2 :][::-1]
            x, y = a[:, i], a[:, j]
            p, q, dot = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(p * q)
            off = np.abs(dot) > ORTHOGONAL * size
            worst = max(worst, float(np.max(np.where(size > 0, np.abs(dot) / np.where(size > 0, size, 1), 0))))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                z = (q - p) / (2 * dot)
                t = np.where(off, np.copysign(1, z) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            x, y = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * x - s * y, s * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if worst <= ORTHOGONAL * math.sqrt(d):
            break
    long = np.sqrt((a * a).sum(axis=0))[:d]
    by = np.argsort(-long, kind="stable")
    return long[by], v[:d, by]


class Whitening:
    """What is fitted: rows, sums, components as columns, their variances, and the trace."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.variances, self.trace = n, sums, components, variances, trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; components without variance give NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred(x, self.n, self.sums) @ self.components / np.where(self.variances > 0, np.sqrt(self.variances), np.nan)


def fit(spark: SparkSession, df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 32, scratch: Scratch | None = None) -> tuple[DataFrame, Whitening | None]:
    """The rows that take part, as _key and _vector, and the first ``count`` components.

    Vectors that are null, empty or hold null, non-finite or enormous entries take no
    part; nor do those whose length is not the most frequent one (of equals the longer).
    Repeated rows count each.  Without a usable vector there is no fit (None).  Variances
    below the rounding error of the largest count as 0.
    """
    scratch = scratch or Scratch(spark, "whitening")
    small_batches(spark)
    rows = usable(df, key, vector)
    lengths = rows.groupBy(F.size("_vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    if lengths is None:
        return rows, None
    d, n = lengths.d, lengths.n
    rows = rows.filter(F.size("_vector") == d)

    def add(batches):
        total = [0] * d
        for batch in batches:
            x = vectors(batch, 0)[1]
            fits = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            total = [a + b for a, b in zip(total, (x if fits else x.astype(object)).sum(axis=0).tolist(), strict=True)]
        # in two parts, so that the sums of tasks fit too
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([t >> 40 for t in total], pa.int64()), pa.array([t & (1 << 40) - 1 for t in total], pa.int64())], names=["at", "high", "low"])

    added = rows.select("_vector").mapInArrow(add, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = [(r.high << 40) + r.low for r in sorted(added)]
    long, components = jacobi(triangle(spark, rows, n, sums, scratch))
    variances = long**2 / n
    variances[long <= long.max(initial=0.0) * d * np.finfo(float).eps] = 0.0
    return rows, Whitening(n, sums, components[:, :count], variances[:count], float(variances.sum()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2, exactly."""
    gap = gaps(x, n, sums)
    if gap.dtype != object and int(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] < 1 << 63:
        return (gap * gap).sum(axis=1).tolist()
    return [sum(g * g for g in row) for row in gap.tolist()]


def whiten(spark: SparkSession, df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 32, scratch: Scratch | None = None) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact; where it exceeds 64 bits it is null.  ``whitened`` is null for
    components without variance, which ``identity_error`` (the largest absolute entry of
    the whitened vectors' covariance minus the identity, over all rows) leaves out;
    without any variance it is null, as is ``explained``.  Rows that take no part (see
    ``fit``) give nothing, nor does an empty table; a null key stays null; repeated rows
    give their rows each; other columns are left out.
    """
    rows, fitted = fit(spark, df, key, vector, count, scratch)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return spark.createDataFrame([], schema)
    k = len(fitted.variances)

    def spread(batches):
        total, inner = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = fitted.project(vectors(batch.slice(at, BLOCK), 0)[1])
                total, inner = total + w.sum(axis=0), inner + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([total, inner.ravel()]))], names=["at", "total"])

    # k * k + k sums, of tasks that each had all of them
    added = rows.select("_vector").mapInArrow(spread, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    sums = np.array([r.total for r in sorted(added)]) / fitted.n
    off = np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k))[np.ix_(fitted.variances > 0, fitted.variances > 0)]
    error = float(off.max()) if off.size else None
    share = [v / fitted.trace if fitted.trace else None for v in fitted.variances.tolist()]

    def give(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                which, x = vectors(part, 1)
                w = fitted.project(x).ravel()
                dev = [v if v < 1 << 63 else None for v in deviations(x, fitted.n, fitted.sums)]
                which, n = np.repeat(which, k), len(which)
                arrays = [
                    part.column(0).take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, fitted.n)),
                    pa.array(dev, pa.int64()).take(pa.array(which)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(share * n, pa.float64()),
                    pa.array([error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("_key", "_vector").mapInArrow(give, schema)
