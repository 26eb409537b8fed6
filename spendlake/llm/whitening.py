"""Whitening of embeddings by polarisation covariance.

Vectors become integers, so every sum is exact. For each dimension, and for the sum of each two dimensions, one
number is aggregated: the sum of squared centred values. As (a + b)**2 = a**2 + 2ab + b**2, all cross-covariances are
differences of such variances. Values are centred on the integer next to their mean; what is left of the mean
is taken off the sums in whole numbers. The driver gets one number per pair of dimensions and finds the eigenvectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.shared import stored

#: Units of an entry that make the whole number.
SCALE = 256
COMPONENTS = 4
ROWS = 1024
#: Partial sums travel as so many parts of 32 bits, so that no sum overflows.
LIMBS = 5
SMALL = 1 << 30


def fine(column: str = "embedding") -> F.Column:
    """Whether a vector is given and holds no null and no non-finite entry."""
    return F.coalesce(F.forall(column, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))), F.lit(False))


def whole(column: str = "embedding", scale: int = SCALE) -> F.Column:
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows of 64-bit integers; shorter ones go on with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """``x - centre``; Python integers where 64 bits, or the squares of sums, might not hold them."""
    large = max([np.abs(x.astype(float)).max(initial=0), *map(abs, centre)])
    return x - np.array(centre, object if large >= SMALL else np.int64)


class Sums:
    """Exact sums of whole numbers, one for each place of a vector, in limbs of 32 bits."""

    def __init__(self, n: int) -> None:
        self.limbs = [np.zeros(n, np.int64) for _ in range(LIMBS)]

    def add(self, at: slice, values: np.ndarray) -> None:
        """Adds the rows of ``values`` (int64, or Python integers) to the places ``at``."""
        for k in range(LIMBS):
            last = k == LIMBS - 1
            low = values if last else values & 0xFFFFFFFF
            self.limbs[k][at] += low.sum(axis=0).astype(np.int64)
            if last or not (values := values >> 32).any():
                break

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(self.limbs[0])))] + [pa.array(x) for x in self.limbs], names=["place", *(f"l{k}" for k in range(LIMBS))])


def exact_sums(rows: DataFrame, n: int, add: Callable[[Sums, pa.Array], None]) -> list[int]:
    """``n`` sums over all ``rows`` (one list column): a task adds its batches up, Spark the tasks; the driver gets n rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(n)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                add(sums, batch.column(0).slice(a, ROWS))
        yield sums.batch()

    found = rows.mapInArrow(task, "place bigint, " + ", ".join(f"l{k} bigint" for k in range(LIMBS)))
    totals = found.groupBy("place").agg(*(F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)))
    out = [0] * n
    for r in totals.collect():
        out[r["place"]] = sum(int(r[f"l{k}"]) << 32 * k for k in range(LIMBS))
    return out


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, their sums, whole centres, components (columns) with eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    centre: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan where a component has no variance."""
        left = np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre)])
        y = centred(x, self.centre).astype(np.float64) - left
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, y @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum)**2, exact."""
        left = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        y = centred(x, self.centre)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * max(len(left), 1) >= 1 << 63:
            y = y.astype(object)
        z = self.n * y - np.array(left, y.dtype)
        return [int(v) for v in (z * z).sum(axis=1)]


def covariance(fit: DataFrame, n: int, dim: int) -> tuple[list[int], list[int], np.ndarray]:
    """(sums, whole centres, covariance with divisor n) of ``fit`` (x)."""
    sums = exact_sums(fit.select("x"), dim, lambda out, column: out.add(slice(None), matrix(column, dim)))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    starts = np.cumsum([0, *range(dim, 0, -1)]).tolist()

    def squares(out: Sums, column: pa.Array) -> None:
        y = centred(matrix(column, dim), centre)
        for i in range(dim):
            both = y[:, i:] + y[:, i : i + 1]
            both[:, 0] = y[:, i]  # the dimension on its own
            out.add(slice(starts[i], starts[i + 1]), both * both)

    found = dict(zip(pairs, exact_sums(fit.select("x"), len(pairs), squares)))
    left = [s - n * c for s, c in zip(sums, centre)]
    # n**2 times the variance of each dimension and of each sum of two
    spread = {(i, j): n * q - (left[i] + left[j] * (i != j)) ** 2 for (i, j), q in found.items()}
    out = np.zeros((dim, dim))
    for i, j in pairs:
        twice = 2 * spread[i, j] if i == j else spread[i, j] - spread[i, i] - spread[j, j]
        out[i, j] = out[j, i] = twice / (2 * n * n)
    return sums, centre, out


def fit_whitening(fit: DataFrame, n: int, dim: int, components: int = COMPONENTS) -> Whitening:
    sums, centre, cov = covariance(fit, n, dim)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    least = dim * np.finfo(float).eps * max(values.max(initial=0), 0)
    return Whitening(n, sums, centre, vectors[:, order], np.where(values[order] > least, values[order], 0), float(np.trace(cov)))


def identity_error(fit: DataFrame, model: Whitening, dim: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components that have variance."""
    live = np.flatnonzero(model.values > 0)
    k = len(live)
    if not k:
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                w = model.project(matrix(batch.column(0).slice(a, ROWS), dim))[:, live]
                w = np.hstack([w, np.ones((len(w), 1))])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["place", "value"])

    found = fit.select("x").mapInArrow(task, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in found:
        total[r["place"]] = r["value"]
    total = total.reshape(k + 1, k + 1) / model.n
    mean = total[:k, k]
    # whitened values are centred already: the mean is of the size of a rounding error
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row of ``vectors`` (vec_id, embedding) in whitened coordinates.

    Entries c become floor(scale * c) in whole numbers. Every different vector counts once in the fit, ``n`` of them. Rows whose vector is null or
    holds null or non-finite entries are left out. Of two lengths, the shorter vector counts as if zeros followed; an empty one is all zeros.
    A component without variance has a null coordinate, and ``identity_error`` regards the others (null if there are none). A deviation beyond
    38 digits is null. Repeated rows and ids are rows of their own; an empty table gives no row; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(fine()).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole(scale=scale).alias("x"))
    fit = stored(rows.select("x").distinct(), "fit")
    n, dim = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    model = fit_whitening(fit, n, dim, components)
    error = identity_error(fit, model, dim)
    explained = model.values / model.trace if model.trace > 0 else np.full(len(model.values), np.nan)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = matrix(part.column(1), dim)
                m, white = len(x), model.project(x)
                deviation = [decimal.Decimal(v) if v < 10**38 else None for v in model.deviation(x)]
                index = pa.array(np.repeat(np.arange(m), k))
                flat = white.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(deviation, pa.decimal128(38, 0)).take(index), pa.array(flat, mask=np.isnan(flat)),
                        pa.array(np.tile(explained, m), mask=np.isnan(np.tile(explained, m))), pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(task, SCHEMA)
